"""Best-fit packing of tokenised documents by non-negative least squares over length patterns.

1. Texts become token ids (one Python pass, Arrow batches); documents longer than a sequence are cut into full pieces.
2. Only the histogram of piece lengths, at most `size` numbers whatever the corpus, reaches the driver. Patterns of one, two or
   three pieces that fill a sequence exactly are enumerated (PARTNERS choices for each longest piece), and repeat counts are
   fitted to the histogram by non-negative least squares (coordinate descent to convergence, whose solutions stay sparse).
3. Counts are rounded down and held to what there is; what remains is packed by best fit on the histogram: longest piece
   first, then an exact filler or pair of fillers if there is one, else the longest that fits; each pattern repeats while
   its lengths last, so every step uses up a length.
4. Pieces are numbered inside their length and look their place up in the plan, whose size is bounded by `size` alone
   (every pattern uses up a length, and a pattern has fewer than sqrt(2 size) lengths), so it is broadcast.

Null and empty texts are the end id alone: pieces of length 1. Ids need not be unique; repeated rows are packed each.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import numbered, staged, table

SIZE = 4096
END_ID = 1
PARTNERS = 48
#: Words whose ids a worker remembers, about 80 MB of them: workers of an executor share its memory.
REMEMBERED = 400_000
#: Texts of these characters only are split here and their words' ids remembered; others go to the tokenizer whole.
_PLAIN = re.compile("[^\t-\r -~¡-ſ‐-‧]")
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Encoder(dict):
    """Little-endian 32-bit ids of texts. As a dict: the ids of whitespace-free strings, kept while they fit."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.split = regex.compile(_PIECES).findall
        with open(path, encoding="utf-8") as f:
            plain = json.load(f)
        # the same merges without normalizer and splitting, for pretokens whose bytes are mapped here
        self.merger = Tokenizer.from_str(json.dumps(plain | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None, "added_tokens": []}))
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.mapped = {b: chr(256 + k) for k, b in enumerate(hidden) if b != 32}  # a space parts pretokens
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(1 + max(self.tokenizer.get_vocab().values()), dtype=bool)
        self.ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def learn(self, words: list[str]) -> None:
        """Remembers the ids of different whitespace-free strings; when that gets too many, of these only. Those of several
        pretokens are put together from them; thousands of new pretokens are encoded as one text and told apart by their
        word-end tokens, of which each has one, its last."""
        new = [w for w in words if w not in self]
        if len(self) + len(new) > REMEMBERED:
            kept = {w: self[w] for w in words if w in self}
            self.clear()
            self.update(kept)
        fresh, several = set(), []
        for w in new:
            if w.isalpha() or len(parts := self.split(w)) == 1 and parts[0] == w:
                fresh.add(w)
            else:
                several.append((w, parts))
                fresh.update(p for p in parts if p not in self)
        groups = [g[k : k + 1000] for g in ([w for w in fresh if w.isascii()], [w for w in fresh if not w.isascii()]) for k in range(0, len(g), 1000)]
        joined = [" ".join(g) for g in groups]
        shown = [t if t.isascii() else t.encode().decode("latin-1").translate(self.mapped) for t in joined]
        for group, e in zip(groups, self.merger.encode_batch_fast(shown, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, dtype="<u4")
            at = [0, *((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()]
            raw = ids.tobytes()
            if len(at) == len(group) + 1:
                self.update((w, raw[i:j]) for w, i, j in zip(group, at, at[1:], strict=False))
            else:
                self.update((w, self.whole(w)) for w in group)
        self.update((w, b"".join(map(self.__getitem__, parts))) for w, parts in several)

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text. Each different word is looked up once; Arrow finds them and lays their ids out in order."""
        plain = [bool(t) and not _PLAIN.search(t) and "<|" not in t for t in texts]
        split = pc.ascii_split_whitespace(pa.array([t.lower() if p else "" for t, p in zip(texts, plain, strict=True)], pa.large_string()))
        found = split.flatten().dictionary_encode()
        words = found.dictionary.to_pylist()
        self.learn(words)
        laid = pa.array(list(map(self.__getitem__, words)), pa.large_binary()).take(found.indices)
        at = np.frombuffer(laid.buffers()[1], dtype=np.int64)[split.offsets.to_numpy()].tolist()
        raw = memoryview(laid.buffers()[2] or b"")
        return [bytes(raw[i:j]) if p else self.whole(t) if t else b"" for t, p, i, j in zip(texts, plain, at, at[1:], strict=False)]


def _chunks(lengths: list[int | None], least: int = 1 << 22) -> Iterator[slice]:
    """Slices of texts of the given bytes that have about `least` bytes, one text at least."""
    start, n = 0, 0
    for k, length in enumerate(lengths):
        n += length or 0
        if n >= least:
            yield slice(start, k + 1)
            start, n = k + 1, 0
    if start < len(lengths):
        yield slice(start, len(lengths))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, path: str | None = None, *, size: int = SIZE, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of the documents. `path`: the tokenizer's file, on every executor;
    by default each executor finds its own."""
    end = np.array([END_ID], dtype="<u4").tobytes()

    types = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()} | ({"ids": pa.binary()} if keep_ids else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path or vocabulary())
        for b in batches:  # only one slice of a batch becomes Python strings at a time
            for part_of in _chunks(pc.binary_length(b.column(1)).to_pylist()):
                at_once = b.slice(part_of.start, part_of.stop - part_of.start)
                out = []
                for i, ids in zip(at_once.column(0).to_pylist(), enc.ids(at_once.column(1).to_pylist()), strict=True):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * size)):
                        part = ids[at : at + 4 * size]
                        out.append((i, k, at // 4, len(part) // 4, zlib.crc32(part), part))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types.values(), strict=False)], names=list(types))

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, schema)


Plan = list[tuple[dict[int, int], int]]  # (pieces of each length in a sequence, repeats)


def patterns(lengths: np.ndarray, size: int) -> list[tuple[int, ...]]:
    """Exact fills by at most three of the lengths; for each longest piece at most PARTNERS choices of the second."""
    have = set(lengths.tolist())
    found: list[tuple[int, ...]] = []
    ordered = np.sort(lengths)[::-1]
    for a in ordered.tolist():
        rest = size - a
        if rest == 0:
            found.append((a,))
        elif rest in have and rest <= a:
            found.append((a, rest))
        seconds = ordered[(ordered <= min(a, rest - 1)) & (2 * ordered >= rest)]
        seconds = seconds[np.isin(rest - seconds, lengths, assume_unique=False)]
        if len(seconds) > PARTNERS:
            seconds = seconds[np.linspace(0, len(seconds) - 1, PARTNERS).astype(int)]
        found += [(a, b, rest - b) for b in seconds.tolist()]
    return found


def fitted(counts: np.ndarray, found: list[tuple[int, ...]]) -> list[float]:
    """Non-negative repeats x that bring sum(x_p pattern_p) near the counts, in least squares: coordinate descent on the
    patterns in use until no step is larger than a quarter (or a thousandth of the largest count), then on all; ends when
    a sweep over all makes no such step either."""
    left = counts.astype(float).tolist()
    x = [0.0] * len(found)
    uses = [list({v: p.count(v) for v in set(p)}.items()) for p in found]
    norms = [sum(c * c for _, c in u) for u in uses]
    small = max(0.25, 1e-3 * float(counts.max(initial=0)))

    def sweep(which) -> float:
        most = 0.0
        for k in which:
            g = 0.0
            for v, c in uses[k]:
                g += c * left[v]
            step = g / norms[k]
            if step < -x[k]:
                step = -x[k]
            if step:
                x[k] += step
                for v, c in uses[k]:
                    left[v] -= c * step
                most = max(most, abs(step))
        return most

    while sweep(range(len(found))) > small:
        active = [k for k in range(len(found)) if x[k] > 0]
        while sweep(active) > small:
            pass
    return x


def packing_plan(counts: np.ndarray, size: int = SIZE) -> Plan:
    """Sequences for counts[length] pieces of each length (1 to size)."""
    left = counts.astype(np.int64).copy()
    plan: Plan = []
    found = patterns(np.flatnonzero(left), size)
    x = fitted(left, found)
    for k in sorted(range(len(found)), key=lambda k: (-x[k], k)):
        uses = {v: found[k].count(v) for v in set(found[k])}
        n = min(int(x[k] + 1e-9), *(int(left[v]) // c for v, c in uses.items()))
        if n > 0:
            plan.append((uses, n))
            for v, c in uses.items():
                left[v] -= c * n
    top = size
    while True:
        while top > 0 and left[top] == 0:
            top -= 1
        if top == 0:
            return plan
        uses, space = {top: 1}, size - top
        left[top] -= 1
        while space:
            if left[space] > 0:
                pick = [space]
            else:
                fit = np.flatnonzero(left[: space + 1] > 0)
                if not len(fit):
                    break
                fit = fit[::-1]
                two = fit[(fit >= space - fit) & (left[space - fit] > (fit == space - fit))]
                pick = [int(two[0]), space - int(two[0])] if len(two) else [int(fit[0])]
            for v in pick:
                uses[v] = uses.get(v, 0) + 1
                left[v] -= 1
                space -= v
        more = min(int(left[v]) // c for v, c in uses.items())
        for v, c in uses.items():
            left[v] -= c * more
        plan.append((uses, 1 + more))


def _table(plan: Plan) -> dict[str, np.ndarray]:
    """Rows by (length, first number): how numbers inside a length map to sequences and offsets."""
    rows, given, sequence = [], {}, 0
    for uses, n in plan:
        offset = 0
        for v in sorted(uses, reverse=True):
            c, k = uses[v], given.get(v, 0)
            rows.append((v, k, c, sequence, offset))
            given[v] = k + c * n
            offset += v * c
        sequence += n
    a = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return {"key": (a[:, 0] << 44) + a[:, 1], "first": a[:, 1], "each": a[:, 2], "sequence": a[:, 3], "offset": a[:, 4]}


def packed(found: DataFrame, *, size: int = SIZE) -> DataFrame:
    """Adds sequence_id and offset to the rows of pieces()."""
    spark = found.sparkSession
    names = [*found.columns, "sequence_id", "offset"]
    found = staged(found, "pieces")
    counts = np.zeros(size + 1, dtype=np.int64)
    for r in found.groupBy("length").count().collect():  # at most `size` rows
        counts[r["length"]] = r["count"]
    at = spark.sparkContext.broadcast(_table(packing_plan(counts, size)))
    ranked = numbered(found, ["length"], ["doc_id", "piece", "ids_crc32"], "_number", least=16)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = at.value
        for b in batches:
            v, k = b["length"].to_numpy(np.int64), b["_number"].to_numpy(np.int64)
            row = np.searchsorted(t["key"], (v << 44) + k, side="right") - 1
            n = k - t["first"][row]
            yield b.assign(sequence_id=t["sequence"][row] + n // t["each"][row], offset=t["offset"][row] + n % t["each"][row] * v)[names]

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema) + ", sequence_id long, offset long"
    return ranked.mapInPandas(run, schema)


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, ids) from packed rows with ids: each sequence's token ids, in the order of offsets. A group holds at most
    one sequence."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: F.hex(x["ids"])), "")
    return placed.groupBy("sequence_id").agg(F.unhex(joined).alias("ids"))


def op1_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of at most 4096 tokens."""
    return packed(pieces(table(spark, sf_dir, "documents")))
