"""Byte-level BPE by walking a trie of the distinct words.

The distinct words of a batch, in byte order, are the depth-first order of
their trie: what two neighbours have in common is their shared path. For every
node the walk keeps one number, the last token of the encoding of the path down
to it. A token ends that encoding if it is a suffix of the path and the token
before it (the state of the node where it starts) may stand beside it, that is,
if no merge across their border comes before the merges that built them.
So each shared prefix is encoded once, a word's tokens are read off backwards
from its node, and time is linear in the word's length, also for very long words.

Defined results: null texts are empty texts; an empty text has no tokens;
strings of special tokens become their token, as the public library does by
default; equal texts get equal results; all other columns stay.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from movelens.llm.text_ids import small_batches

#: Words kept between batches in one Python worker, and words handled at a time in one text.
CACHE_WORDS = 400_000
CHUNK_CHARS = 1_000_000

# The word pattern of the public byte-level pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
# The same pattern for texts below U+0250, where the classes can be written out.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾", "\\t-\\r \x85\xa0"
NARROW = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
_wide, _narrow, _beyond = regex.compile(PATTERN), re.compile(NARROW), re.compile("[^\x00-ɏ]")


def byte_letters() -> dict[str, int]:
    """The public byte alphabet: printable Latin-1 bytes stand for themselves, the others follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and the borders of each token; small and of fixed size."""

    def __init__(self, source: str) -> None:
        spec = json.loads(source)
        letters = byte_letters()
        tokens = {t: i for t, i in spec["model"]["vocab"].items()}
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        size = 1 + max([*tokens.values(), *self.special.values()])
        self.bytes: list[bytes] = [b""] * size
        for t, i in tokens.items():
            self.bytes[i] = bytes(letters[c] for c in t)
        for t, i in self.special.items():
            self.bytes[i] = t.encode()
        self.rank: dict[tuple[int, int], int] = {}
        parts: dict[int, tuple[int, int, int]] = {}
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            pair, made = (tokens[a], tokens[b]), tokens[a + b]
            self.rank[pair] = r
            parts.setdefault(made, (*pair, r))
        # Tokens at a token's right (left) border, with the rank of the merge that takes each of them up.
        never = len(self.rank)
        self.right: list[list[tuple[int, int]]] = [[(i, never)] for i in range(size)]
        self.left: list[list[tuple[int, int]]] = [[(i, never)] for i in range(size)]
        for i in range(size):
            at = i
            while at in parts:
                _, at, r = parts[at]
                self.right[i].append((at, r))
            at = i
            while at in parts:
                at, _, r = parts[at]
                self.left[i].append((at, r))
        # Only tokens that their own bytes encode to can end an encoding.
        self.id_of = {
            self.bytes[i]: i for t, i in tokens.items()
            if i not in parts or not self.crosses(parts[i][0], parts[i][1], parts[i][2])
        }
        self.longest = max(map(len, self.id_of))
        self.known: dict[tuple[int, int], bool] = {}
        self.name = [str(i) for i in range(size)]

    def crosses(self, a: int, b: int, below: int | None = None) -> bool:
        """Whether a merge across the border of a and b comes first (of those of a rank under ``below``)."""
        for x, until_x in self.right[a]:
            for y, until_y in self.left[b]:
                r = self.rank.get((x, y))
                if r is not None and r < until_x and r <= until_y and (below is None or r < below):
                    return True
        return False

    def beside(self, a: int, b: int) -> bool:
        known = self.known.get((a, b))
        if known is None:
            if len(self.known) > 2_000_000:
                self.known.clear()
            known = self.known[a, b] = not self.crosses(a, b)
        return known

    def encode_words(self, words: list[bytes]) -> dict[bytes, tuple[int, ...]]:
        """Token ids of distinct words, by a walk through their trie."""
        out: dict[bytes, tuple[int, ...]] = {}
        id_of, beside, longest, size = self.id_of.get, self.beside, self.longest, self.bytes
        last: list[int] = [-1]  # of the path so far: the last token of each prefix
        before = b""
        for word in sorted(words):
            shared, most = 0, min(len(word), len(before))
            if word[:most] == before[:most]:
                shared = most
            else:
                while word[shared] == before[shared]:
                    shared += 1
            del last[shared + 1:]
            for end in range(shared + 1, len(word) + 1):
                for start in range(max(0, end - longest), end):
                    t = id_of(word[start:end])
                    if t is not None and (start == 0 or beside(last[start], t)):
                        last.append(t)
                        break
                else:
                    raise ValueError(f"the vocabulary has no token for byte {word[end - 1]}")
            before, at, ids = word, len(word), []
            while at:
                ids.append(last[at])
                at -= len(size[last[at]])
            out[word] = tuple(reversed(ids))
        return out


def pieces(text: str, specials: regex.Pattern | None) -> Iterator[tuple[str, bool]]:
    """The text between special tokens, and these; whole where there are none."""
    at = 0
    for m in specials.finditer(text) if specials else ():
        if m.start() > at:
            yield text[at:m.start()], False
        yield m.group(), True
        at = m.end()
    if at < len(text):
        yield text[at:], False


def words_of(text: str) -> Iterator[list[str]]:
    """The pattern's words, in lists of bounded length for long texts."""
    pattern = _wide if _beyond.search(text) else _narrow
    if len(text) <= CHUNK_CHARS:
        yield pattern.findall(text)
        return
    found = (m.group() for m in pattern.finditer(text))
    while part := list(itertools.islice(found, CHUNK_CHARS // 8)):
        yield part


class Encoder:
    """Encodes texts with one vocabulary, keeping the encodings of words between batches."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary, self.cache = vocabulary, {}
        names = sorted(vocabulary.special, key=len, reverse=True)
        self.specials = regex.compile("|".join(map(regex.escape, names))) if names else None

    def learn(self, words: set[str]) -> None:
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        new = words.difference(self.cache)
        coded = self.vocabulary.encode_words([w.encode() for w in new])
        self.cache.update((w, coded[w.encode()]) for w in new)

    def encode(self, text: str) -> Iterator[list[int]]:
        """Token ids, part by part."""
        for part, special in pieces(text, self.specials):
            if special:
                yield [self.vocabulary.special[part]]
                continue
            for words in words_of(part):
                cache = self.cache
                try:
                    yield list(itertools.chain.from_iterable(map(cache.__getitem__, words)))
                except KeyError:
                    self.learn(set(words))
                    yield list(itertools.chain.from_iterable(map(self.cache.__getitem__, words)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.bytes.__getitem__, ids))


_ENCODERS: dict[str, Encoder] = {}


def _encoder(source: str) -> Encoder:
    key = hashlib.sha256(source.encode()).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(Vocabulary(source))
    return _ENCODERS[key]


def _texts(batch: pa.RecordBatch, column: str) -> list[str]:
    return [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def _prepare(encoder: Encoder, texts: list[str]) -> None:
    """One trie for the words of the batch's shorter texts; long texts add theirs as they come."""
    at, budget = 0, 4 * CHUNK_CHARS
    words: set[str] = set()
    while at < len(texts) and budget > 0:
        if len(texts[at]) <= CHUNK_CHARS:
            for part, special in pieces(texts[at], encoder.specials):
                if not special:
                    for some in words_of(part):
                        words.update(some)
        budget -= len(texts[at])
        at += 1
    encoder.learn(words)


def vocabulary_source(path: str) -> str:
    """The vocabulary file, read once on the driver; its size does not depend on the data."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def with_tokens(df: DataFrame, text: str, path: str, ids: str = "token_ids", back: str | None = None) -> DataFrame:
    """Adds the token ids of a text column as an array, and with ``back`` a column of the text decoded from them."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(vocabulary_source(path))
    keep = [c for c in df.columns if c not in (ids, back)]
    added = [T.StructField(ids, T.ArrayType(T.IntegerType(), False)), *([T.StructField(back, T.StringType())] if back else [])]
    schema = T.StructType([*df.select(*keep).schema.fields, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for whole in batches:
            for batch in _slices(whole, text):
                texts = _texts(batch, text)
                _prepare(encoder, texts)
                coded = [list(itertools.chain.from_iterable(encoder.encode(t))) for t in texts]
                kept = [batch.column(batch.schema.get_field_index(c)) for c in keep]
                out = [*kept, pa.array(coded, pa.list_(pa.int32()))]
                if back:
                    out.append(pa.array([encoder.decode(x).decode("utf-8", "replace") for x in coded], pa.string()))
                yield pa.RecordBatch.from_arrays(out, names=schema.fieldNames())

    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def _slices(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most CHUNK_CHARS characters of text, or one row."""
    lengths = pc.fill_null(pc.utf8_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy()
    ends, low = np.cumsum(lengths), 0
    while low < batch.num_rows:
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + CHUNK_CHARS, "right")))
        yield batch.slice(low, high - low)
        low = high


def decoded(df: DataFrame, ids: str, path: str, text: str = "text") -> DataFrame:
    """Adds the text that an array of token ids stands for."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(vocabulary_source(path))
    keep = [c for c in df.columns if c != text]
    schema = T.StructType([*df.select(*keep).schema.fields, T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            texts = [encoder.decode(x or []).decode("utf-8", "replace") for x in lists]
            kept = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string())], names=[*keep, text])

    return df.mapInArrow(run, schema)


def encoding_digests(df: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """Per row: number of tokens, digest of the ids, digest of the text decoded from them."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(vocabulary_source(path))
    fields = [df.select(key).schema.fields[0], *[T.StructField(n, t) for n, t in (
        ("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType()))]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for batch in batches:
            texts = _texts(batch, text)
            counts, id_sums, text_sums = np.zeros(len(texts), np.int64), [], []
            for i, t in enumerate(texts):
                if i % 1000 == 0:
                    _prepare(encoder, texts[i:i + 1000])
                names, plain, first = hashlib.sha256(), hashlib.sha256(), True
                for ids in encoder.encode(t):
                    if ids:
                        names.update(("" if first else ",").encode())
                        names.update(",".join(map(encoder.vocabulary.name.__getitem__, ids)).encode())
                        # bytes of a valid text; a cut between parts never divides a character
                        plain.update(encoder.decode(ids))
                        counts[i] += len(ids)
                        first = False
                id_sums.append(names.hexdigest())
                text_sums.append(plain.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(key)), pa.array(counts), pa.array(id_sums, pa.string()),
                 pa.array(text_sums, pa.string())], names=[f.name for f in fields])

    return df.select(key, text).mapInArrow(run, T.StructType(fields))
