"""Byte-level BPE encoding and decoding by finite-state machines.

The merges of a rank file are compiled into a nondeterministic transducer.  Its
state is a token just finished and a place in the trie of token bytes; at a
token's end it may write the token, if no merge would ever join the two across
their border.  The merges of a byte string are those of its parts whenever all
its borders are such, so for every string exactly one path of whole tokens is
left, and that is its encoding.

``Transducer`` makes it deterministic while it reads: a state is the set of
paths still possible, each with the tokens on which the paths differ; what all
of them share is written at once, so that a token leaves after a lookahead that
the vocabulary bounds.  States and arrows are made when first met, until there
are ``MOST_ARROWS``; what is rarer is followed path by path, and arrows are made
anew when that becomes the rule.  Memory stays bounded on any input.

Texts are split by a pattern and every match is encoded by itself; a match that
is one token's bytes is that token, whatever the merges.  ``TextStream`` decodes
tokens as they come: a byte-wise machine knows how many bytes a character still
lacks and which may follow, and its moves over whole tokens are remembered.
Characters cut by a token's end wait for the rest; what cannot become a
character turns into U+FFFD, one for each longest ill-formed part.

Null texts have null ids, and the query takes them for empty ones; an empty text
has no ids.  Rows are independent, so repeated rows get equal results.  Long
texts are encoded some thousand matches at a time, a long match byte by byte.
Empty tables give empty results.
"""

from __future__ import annotations

import base64
import hashlib
import sys
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweir.llm.common import table

#: Most bytes of a rank file: it is read by the driver and broadcast.
MOST_FILE_BYTES = 64 << 20
MOST_ARROWS = 240_000
#: Matches whose ids a worker remembers, and the longest of them.
MOST_MATCHES, LONGEST_MATCH = 450_000, 64
#: Texts of more characters are split some matches at a time.
LONG_TEXT, MATCHES = 1_000_000, 20_000
_NEVER = 1 << 60


class Vocabulary:
    """Tokens by id, and of each token that merges make the two that the last merge joins."""

    def __init__(self, ranks: dict[bytes, int]):
        if len(set(ranks.values())) != len(ranks) or any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("a byte-level vocabulary holds every byte, and no id twice")
        self.ranks, self.bytes = ranks, {i: b for b, i in ranks.items()}
        self.parts: dict[int, tuple[int, int]] = {}
        self.made = {ranks[bytes([b])] for b in range(256)}  # tokens that merges can end in
        for token in sorted(ranks, key=lambda t: ranks[t]):
            if len(token) > 1 and (parts := self._last_merge(token)):
                self.parts[ranks[token]] = parts
                self.made.add(ranks[token])
                if max(self._birth(p) for p in parts) > ranks[token]:
                    raise ValueError(f"{token!r} has a lower rank than what it is made of")
        self.digest = hashlib.sha256(b"".join(b"%d %s\n" % (i, base64.b64encode(b)) for b, i in sorted(ranks.items()))).hexdigest()

    def _birth(self, token: int) -> int:
        return token if token in self.parts else -1

    def _last_merge(self, token: bytes) -> tuple[int, int] | None:
        """The two tokens whose merge is the last one in the token's own bytes; None if these end in several tokens."""
        parts, last = [token[k : k + 1] for k in range(len(token))], None
        while len(parts) > 1:
            rank, k = min((self.ranks.get(parts[k] + parts[k + 1], _NEVER), k) for k in range(len(parts) - 1))
            if rank == _NEVER:
                return None
            last = (parts[k], parts[k + 1])
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return self.ranks[last[0]], self.ranks[last[1]]

    def apart(self, left: int, right: int) -> bool:
        """Whether no merge joins the two tokens' bytes across their border, from the latest moment back to single bytes."""
        left_until = right_until = _NEVER
        while True:
            rank = self.ranks.get(self.bytes[left] + self.bytes[right], _NEVER)
            if rank < left_until and rank <= right_until and rank < _NEVER:  # of equal ranks the pair on the left is first
                return False
            a, b = self._birth(left), self._birth(right)
            if a < 0 and b < 0:
                return True
            if a > b:
                left, left_until = self.parts[left][1], left
            else:
                right, right_until = self.parts[right][0], right


class Transducer:
    """Bytes to tokens, determinised as far as the input has needed."""

    def __init__(self, vocabulary: Vocabulary, most_arrows: int = MOST_ARROWS):
        self.vocabulary, self.most_arrows = vocabulary, most_arrows
        self.child: dict[int, int] = {}
        self.token = [-1]
        self.inner = [False]  # places with more bytes below them
        for token, number in vocabulary.ranks.items():
            at = 0
            for byte in token:
                key = at << 8 | byte
                self.inner[at] = True
                if key not in self.child:
                    self.child[key] = len(self.token)
                    self.token.append(-1)
                    self.inner.append(False)
                at = self.child[key]
            self.token[at] = number
        self.made = [t if t in vocabulary.made else -1 for t in self.token]
        self._forget()

    def _forget(self) -> None:
        self.arrows: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.states: list[tuple] = []
        self.number: dict[tuple, int] = {}
        self.last: list[tuple[int, ...]] = []
        self.pairs: dict[int, bool] = {}
        self.missed = 0
        self._state(((-1, 0, ()),))  # (token before, place in the trie, tokens not written yet)

    def _state(self, paths: tuple) -> int:
        known = self.number.get(paths)
        if known is None:
            known = self.number[paths] = len(self.states)
            self.states.append(paths)
            self.last.append(self._end(paths))
        return known

    def _end(self, paths: tuple) -> tuple[int, ...]:
        """What is left to write where the bytes end: a whole token, or the path that has just ended one."""
        whole = next((self.token[place] for before, place, _ in paths if before < 0 and self.token[place] >= 0), None)
        return paths[-1][2] if whole is None else (whole,)

    def _step(self, paths: tuple, byte: int) -> tuple[tuple, tuple[int, ...]]:
        """The paths after one more byte, and the tokens that they all share."""
        after, ended, child = [], None, self.child
        for before, place, waiting in paths:
            place = child.get(place << 8 | byte)
            if place is None:
                continue
            if ended is None and (token := self.made[place]) >= 0 and (before < 0 or self._apart(before, token)):
                ended = (token, 0, (*waiting, token))
            if self.inner[place] or before < 0:
                after.append((before, place, waiting))
        after.append(ended)
        first = after[0][2]
        if not first:
            return tuple(after), first
        shared = 0
        while shared < len(first) and all(len(w) > shared and w[shared] == first[shared] for _, _, w in after):
            shared += 1
        return (tuple([(b, p, w[shared:]) for b, p, w in after]) if shared else tuple(after)), first[:shared]

    def _arrow(self, state: int, byte: int) -> tuple[int, tuple[int, ...]] | None:
        """A new arrow; None once there are enough of them, for what is rare is followed without."""
        if len(self.arrows) >= self.most_arrows:
            self.missed += 1
            return None
        paths, written = self._step(self.states[state], byte)
        arrow = self.arrows[state << 8 | byte] = self._state(paths), written
        return arrow

    def _start(self) -> int:
        """The first state; where the input has become another one, arrows are made anew for it."""
        if self.missed > 8 * self.most_arrows:
            self._forget()
        return 0

    def _apart(self, before: int, token: int) -> bool:
        key = before << 32 | token
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= MOST_ARROWS:
                self.pairs.clear()
            known = self.pairs[key] = self.vocabulary.apart(before, token)
        return known

    def tokens(self, chunks: Iterable[bytes]) -> Iterator[int]:
        """Tokens of one match whose bytes come in chunks, each as soon as it is certain."""
        paths = self.states[self._start()]
        for chunk in chunks:
            for byte in chunk:
                paths, written = self._step(paths, byte)
                yield from written
        yield from self._end(paths)

    def encode(self, match: bytes) -> list[int]:
        out, state, get = [], self._start(), self.arrows.get
        for k, byte in enumerate(match):
            arrow = get(state << 8 | byte) or self._arrow(state, byte)
            if arrow is None:
                paths = self.states[state]
                for rest in match[k:]:
                    paths, written = self._step(paths, rest)
                    out += written
                out += self._end(paths)
                return out
            state, written = arrow
            out += written
        out += self.last[state]
        return out


class _Matches(dict):
    """Ids of matches as little-endian 32-bit numbers; of those met lately, the last ``MOST_MATCHES`` and as many before them."""

    def __init__(self, transducer: Transducer):
        self.transducer, self.before = transducer, {}

    def __missing__(self, match: str) -> bytes:
        value = self.before.get(match) or _little(self.transducer.encode(match.encode("utf-8", "replace")))
        if len(match) <= LONGEST_MATCH:
            if len(self) >= MOST_MATCHES:
                self.before = dict(self)
                self.clear()
            self[match] = value
        return value


def _little(numbers: list[int]) -> bytes:
    words = array("I", numbers)
    if sys.byteorder == "big":
        words.byteswap()
    return words.tobytes()


class Encoder:
    """Texts to ids, each match of a pattern by itself."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.pattern, self.matches = regex.compile(pattern), _Matches(Transducer(vocabulary))

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if len(text) <= LONG_TEXT:
            return b"".join(map(self.matches.__getitem__, self.pattern.findall(text)))
        found, out = (m.group() for m in self.pattern.finditer(text)), []
        while part := b"".join(map(self.matches.__getitem__, islice(found, MATCHES))):
            out.append(part)
        return b"".join(out)


def utf8_step(state: tuple[int, int, int], byte: int) -> tuple[int, int, int] | None:
    """One byte of a character: (bytes it still lacks, least and greatest that may follow); None where the byte can't stand there."""
    lacks, low, high = state
    if lacks:
        return (lacks - 1, 0x80, 0xBF) if low <= byte <= high else None
    if byte < 0x80:
        return (0, 0, 0)
    if 0xC2 <= byte <= 0xDF:
        return (1, 0x80, 0xBF)
    if 0xE0 <= byte <= 0xEF:
        return (2, 0xA0 if byte == 0xE0 else 0x80, 0x9F if byte == 0xED else 0xBF)  # no overlong forms, no surrogates
    if 0xF0 <= byte <= 0xF4:
        return (3, 0x90 if byte == 0xF0 else 0x80, 0x8F if byte == 0xF4 else 0xBF)
    return None


class TextStream:
    """Tokens to text: ``add`` returns the characters that a token completes."""

    START = (0, 0, 0)

    def __init__(self, tokens: dict[int, bytes], known: dict | None = None):
        self.tokens, self.known, self.state, self.held = tokens, {} if known is None else known, self.START, b""

    def _over(self, held: bytes, state: tuple[int, int, int], token: int) -> tuple[bytes, tuple[int, int, int], str]:
        text = []
        for byte in self.tokens[token]:
            after = utf8_step(state, byte)
            if after is None and held:  # what was held can't be a character; the byte may begin one
                text.append("�")
                held, after = b"", utf8_step(self.START, byte)
            if after is None:
                text.append("�")
                held, state = b"", self.START
                continue
            held, state = held + bytes([byte]), after
            if not state[0]:
                text.append(held.decode())
                held, state = b"", self.START
        return held, state, "".join(text)

    def add(self, token: int) -> str:
        key = (self.held, token)
        if key not in self.known:
            if len(self.known) >= MOST_ARROWS:
                self.known.clear()
            self.known[key] = self._over(self.held, self.state, token)
        self.held, self.state, text = self.known[key]
        return text

    def end(self) -> str:
        """What is left of a character that never came whole."""
        held, self.held, self.state = self.held, b"", self.START
        return "�" if held else ""


class Decoder:
    def __init__(self, vocabulary: Vocabulary):
        self.tokens, self.known, self.whole = vocabulary.bytes, {}, {}
        self.cut = np.ones(max(vocabulary.bytes) + 1, bool)  # tokens that are no whole characters
        for token, data in vocabulary.bytes.items():
            stream = TextStream(vocabulary.bytes)
            text = stream.add(token)
            if not stream.held and "�" not in text:
                self.whole[token], self.cut[token] = text, False

    def decode(self, ids: bytes) -> str:
        """The text of little-endian unsigned 32-bit ids."""
        numbers = np.frombuffer(ids, "<u4")
        tokens, at = numbers.tolist(), 0
        if not len(cuts := self.cut[numbers].nonzero()[0].tolist()):
            return "".join(map(self.whole.__getitem__, tokens))
        out, stream = [], TextStream(self.tokens, self.known)
        for k in cuts:
            if k >= at:  # whole characters up to the next cut, then token by token until a character is whole again
                out += map(self.whole.__getitem__, tokens[at:k])
                at = k
                while True:
                    out.append(stream.add(tokens[at]))
                    at += 1
                    if not stream.held or at == len(tokens):
                        break
        out += map(self.whole.__getitem__, tokens[at:])
        return "".join(out) + stream.end()


_machines: dict = {}


def _machine(kind: type, vocabulary: Vocabulary, *more: str):
    """One for each worker process, so that what it has learned stays between batches and tasks."""
    key = (kind, vocabulary.digest, *more)
    if key not in _machines:
        _machines[key] = kind(vocabulary, *more)
    return _machines[key]


class Tokenizer:
    """Columns of ids and of texts. The compiled vocabulary is broadcast once."""

    def __init__(self, spark: SparkSession, ranks: str, pattern: str):
        with open(ranks, "rb") as file:
            raw = file.read(MOST_FILE_BYTES + 1)
        if len(raw) > MOST_FILE_BYTES:
            raise ValueError(f"{ranks} has more than {MOST_FILE_BYTES} bytes")
        pairs = map(bytes.split, filter(None, raw.split(b"\n")))
        self.vocabulary = spark.sparkContext.broadcast(Vocabulary({base64.b64decode(token): int(rank) for token, rank in pairs}))
        self.pattern = pattern

    def ids(self, text: Column) -> Column:
        """Binary: little-endian unsigned 32-bit ids of a text; null for null."""
        vocabulary, pattern = self.vocabulary, self.pattern

        def encode(texts: pa.Array) -> pa.Array:
            encoder = _machine(Encoder, vocabulary.value, pattern)
            return pa.array((None if not t.is_valid else encoder.encode(t.as_py().decode("utf-8", "replace")) for t in texts), pa.binary())

        return F.arrow_udf(encode, "binary")(text.cast("binary"))

    def text(self, ids: Column) -> Column:
        """The text of such ids; null for null."""
        vocabulary = self.vocabulary

        def decode(values: pa.Array) -> pa.Array:
            decoder = _machine(Decoder, vocabulary.value)
            return pa.array((None if not v.is_valid else decoder.decode(v.as_py()) for v in values), pa.string())

        return F.arrow_udf(decode, "string")(ids)


def n_ids(ids: Column) -> Column:
    return (F.octet_length(ids) / 4).cast("long")


def op11_bpe_transducer(spark: SparkSession, sf_dir: str, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """Ids of all whole documents, and the texts that they decode to."""
    import public_tokenizers

    tokenizer = Tokenizer(spark, ranks or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN)
    docs = table(spark, sf_dir, "documents").select("doc_id", tokenizer.ids(F.coalesce("text", F.lit(""))).alias("ids"))
    return docs.select("doc_id", n_ids(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(tokenizer.text(F.col("ids")).cast("binary"), 256).alias("decoded_sha256"))
