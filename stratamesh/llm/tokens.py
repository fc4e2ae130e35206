"""Encoding of texts with a public byte-level BPE tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = os.environ.get("STRATAMESH_TOKENIZERS", "/opt/tokenizers")
BYTE_BPE_50K = "byte_bpe_50k.tiktoken"

# Fixed value: the published split pattern of the 50k byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoding(path: str) -> tiktoken.Encoding:
    """The encoder of a rank file, kept per Python worker. It has no special tokens: their text is ordinary text."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def _splitter() -> regex.Pattern:
    return regex.compile(PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


#: The characters that are white space to the split pattern (those of the Unicode property).
_WHITE = frozenset("\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def segments(text: str, limit: int) -> list[tuple[str, str]]:
    """Cuts a long text into parts of about ``limit`` characters: (kind, part).

    The kinds: ``text`` is encoded as any text; ``word`` is one word of the split pattern, encoded unsplit; ``more`` goes
    on with the word before, and tokens may span the join. Parts of kind ``text`` end at the end of a word and never in
    white space, because the pattern looks one character ahead there (a run of white space leaves its last character to
    what follows). Where a word over ``limit`` comes after white space, that white space is given as words of its own.
    Cuts before white space are preferred; only a single word over ``limit`` is halved until its parts fit.
    """
    out: list[tuple[str, str]] = []
    start = safe = best = 0  # safe: the last place where a part may end, best: the last such place before white space
    tail: list[tuple[int, int]] = []  # the words after safe, all white space
    for m in _splitter().finditer(text):
        a, b = m.span()
        if b - a > limit:
            if safe > start:
                out.append(("text", text[start:safe]))
            out.extend(("word", text[i:j]) for i, j in tail)
            out.extend(("more" if k else "word", part) for k, part in enumerate(_halves(text[a:b], limit)))
            start, safe, tail = b, b, []
            continue
        if b - start > limit and safe > start:
            end = best if best > start else safe
            out.append(("text", text[start:end]))
            start = end
        if text[b - 1] in _WHITE:
            tail.append((a, b))
        else:
            safe, tail = b, []
            if b < len(text) and text[b] in _WHITE:
                best = b
    if start < len(text):
        out.append(("text", text[start:]))
    return out


def _halves(word: str, limit: int) -> list[str]:
    if len(word) <= limit:
        return [word]
    mid = len(word) // 2
    return _halves(word[:mid], limit) + _halves(word[mid:], limit)


def join_encoded(enc: tiktoken.Encoding, a: np.ndarray, b: np.ndarray, window: int = 8) -> np.ndarray:
    """The encoding of one word from those of its two halves.

    A window of tokens on both sides of the join is encoded anew and grown until its first token is the one the left
    half had there and its last the one the right half had, or a half is used up. Then every pair of neighbours in
    the result is one that some encoding has produced, and in a byte-pair encoding whose tokens all encode to
    themselves a sequence of tokens is the encoding of its text exactly if all its neighbouring pairs are such pairs.
    """
    i = j = window
    while True:
        i, j = min(i, len(a)), min(j, len(b))
        raw = b"".join(enc.decode_single_token_bytes(int(t)) for t in a[len(a) - i :]) + b"".join(enc.decode_single_token_bytes(int(t)) for t in b[:j])
        w = enc._core_bpe.encode_single_piece(raw)
        left, right = i == len(a) or w[0] == a[len(a) - i], j == len(b) or w[-1] == b[j - 1]
        if left and right:
            return np.concatenate([a[: len(a) - i], np.asarray(w, np.uint32), b[j:]])
        i, j = i if left else 2 * i, j if right else 2 * j


def join_all(enc: tiktoken.Encoding, parts: list[np.ndarray], window: int = 8) -> np.ndarray:
    """Joins the parts of one word as a balanced tree."""
    while len(parts) > 1:
        parts = [join_encoded(enc, parts[k], parts[k + 1], window) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    return parts[0]


def encode_text(enc: tiktoken.Encoding, text: str | None) -> np.ndarray:
    return enc.encode_to_numpy(text, disallowed_special=()) if text else np.empty(0, np.uint32)


def encode_part(enc: tiktoken.Encoding, kind: str, text: str) -> np.ndarray:
    return encode_text(enc, text) if kind == "text" else np.asarray(enc._core_bpe.encode_single_piece(text.encode()), np.uint32)


def join_parts(enc: tiktoken.Encoding, parts: Iterable[tuple[str, np.ndarray]]) -> np.ndarray:
    """The encoding of a text from those of its ``segments``, in order."""
    words: list[list[np.ndarray]] = []
    for kind, ids in parts:
        words[-1].append(ids) if kind == "more" else words.append([ids])
    return np.concatenate([np.empty(0, np.uint32), *[join_all(enc, w) for w in words]])


def slices(batch: pa.RecordBatch, text: int, rows: int = 1024, size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """``batch`` in pieces of at most ``rows`` rows and about ``size`` bytes of column ``text``, at least a row each."""
    length = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).cumsum()
    at = 0
    while at < batch.num_rows:
        most = np.searchsorted(length, (length[at - 1] if at else 0) + size, "right")
        end = min(batch.num_rows, at + rows, max(at + 1, int(most)))
        yield batch.slice(at, end - at)
        at = end


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)], dtype=np.int64)
    flat = np.concatenate([np.empty(0, np.uint32), *arrays]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))


def encode(df: DataFrame, text: str, out: str, *, path: str | None = None, count_only: bool = False, long_chars: int = 1_000_000, segment_chars: int = 100_000) -> DataFrame:
    """``df`` with ``out``: the ids of ``text`` as list<int>, or their number (bigint) with ``count_only``.

    Texts of up to ``long_chars`` characters are encoded where they lie, in Arrow batches without a shuffle. Longer
    ones are cut into segments that are spread over the cluster, encoded in parallel and joined in order; where a
    segment ends inside one unsplit word, the encodings are joined by tree concatenation (see ``join_encoded``), so
    the ids are exactly those of the whole text whatever the cuts.

    Defined results: null and empty text give an empty list (0); special-token text is ordinary text; repeated rows
    stay, repeated long texts are encoded once; an empty table gives none; other columns pass through, one named
    ``out`` is replaced.
    """
    file = path or f"{TOKENIZERS}/{BYTE_BPE_50K}"
    df = df.drop(out) if out in df.columns else df
    kind = "bigint" if count_only else "array<int>"
    names = df.columns
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    at = names.index(text)

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(file)
        for batch in batches:
            for part in slices(batch, at):
                ids = [encode_text(enc, t.as_py()) for t in part.column(at)]
                new = pa.array([len(x) for x in ids], pa.int64()) if count_only else _lists(ids)
                yield pa.RecordBatch.from_arrays([*part.columns, new], [*names, out])

    is_long = F.length(text) > long_chars
    near = df.where(~F.coalesce(is_long, F.lit(False))).mapInArrow(short, f"{head}, `{out}` {kind}")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sha, t in zip(batch.column(0), batch.column(1)):
                parts = segments(t.as_py(), segment_chars)
                for k in range(0, len(parts), 64):
                    some = parts[k : k + 64]
                    yield pa.RecordBatch.from_arrays([pa.array([sha.as_py()] * len(some)), pa.array(range(k, k + len(some)), pa.int32()), pa.array([p for p, _ in some]), pa.array([p for _, p in some])], ["sha", "no", "kind", "part"])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(file)
        for b in batches:
            for x in slices(b, 3):
                ids = _lists([encode_part(enc, k.as_py(), p.as_py()) for k, p in zip(x.column(2), x.column(3))])
                yield pa.RecordBatch.from_arrays([*x.columns[:3], ids], ["sha", "no", "kind", "ids"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(file)
        for b in batches:
            for sha, parts in zip(b.column(0), b.column(1)):
                whole = join_parts(enc, ((p["kind"].as_py(), p["ids"].values.to_numpy(zero_copy_only=False).astype(np.uint32)) for p in parts))
                new = pa.array([len(whole)], pa.int64()) if count_only else _lists([whole])
                yield pa.RecordBatch.from_arrays([pa.array([sha.as_py()]), new], ["_sha", out])

    far = df.where(is_long).withColumn("_sha", F.sha2(text, 256))
    ids = (
        far.select("_sha", text).dropDuplicates(["_sha"])
        .mapInArrow(cut, "sha string, no int, kind string, part string")
        .repartition("sha", "no")
        .mapInArrow(code, "sha string, no int, kind string, ids array<int>")
        .groupBy("sha").agg(F.sort_array(F.collect_list(F.struct("no", "kind", "ids"))).alias("parts"))
        .mapInArrow(join, f"_sha string, `{out}` {kind}")
    )
    return near.unionByName(far.join(ids, "_sha").drop("_sha"))
