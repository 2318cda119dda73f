"""Near-duplicate detection by MinHash with tensored banding.

A document is the set of its distinct word shingles. Two smaller collections of minhashes are drawn, A (TA groups of RA) and B
(TB groups of RB); table (i, j) is keyed by group i of A with group j of B. TA * TB tables of RA + RB minhashes so cost
TA * RA + TB * RB minhashes (52, where plain banding computes 480). A pair of similarity 0.8 shares a key with
probability (1 - (1 - 0.8^2)^8) (1 - (1 - 0.8^3)^12) > 0.9995.

1. One pass over the texts gives set size, a 128-bit set hash, the minhashes and a sketch (a byte of each minhash and of the
   least element in each of BINS bins). Equal sets become one class; everything below is about classes.
2. Classes meet under their keys; keys that one class alone has are dropped. A bucket's leader is its class with most meetings,
   so a group around one original is led by it in every table where it stands.
3. Every class is held against the leader that its sketch is nearest to: full sets are compared where sketches don't rule the
   similarity out (five standard deviations below it). Links are contracted to components: most groups close here.
4. Buckets that still hold several components are searched whole. Those of one leader become one group; in bounded blocks
   (members outside its largest component against all), sketches name the members worth reading, then their full sets are
   compared and each block returns a spanning forest of links. No cap drops candidates and no list of all pairs is written:
   every table above has at most a row for each class and key, or for each class and block.
A mapper that sees a key more than SPREAD times opens further buckets for it, led in common, so no task gathers a hot key.

Texts without words have an empty set: no links, component of their own. Null ids are linked with nothing (component null).
Repeated rows share one class; rows of one id with other texts are versions of one document, which has the links of each.
Texts of any length are read whole: a set is held in memory once for each row of a block, blocks are bounded by set sizes.
Empty tables give empty results. Columns beside doc_id and text play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.graph import contracted
from .common import discard, free_name, staged, table

TA, RA, TB, RB = 8, 2, 12, 3
HASHES = TA * RA + TB * RB
BINS = 128
SPREAD = 64
#: Members and set elements that a block holds a side.
BLOCK_ROWS, BLOCK_ELEMENTS = 4096, 2_000_000
#: Rows (a few numbers each) up to which the list of texts to read is broadcast; more are joined by shuffle.
FEW = 200_000
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_rng = np.random.default_rng(20_251)
_MUL = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_ODD = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_C5, _C6 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _C5
    x = (x ^ (x >> np.uint64(27))) * _C6
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    """Hashes of words, kept while they fit."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_words = _Hashes()


def shingles(text: str | None, width: int) -> np.ndarray:
    """The distinct 64-bit hashes of the text's shingles, sorted; of all its words together if fewer than `width`."""
    w = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    n = len(w)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, w), dtype=np.uint64, count=n)
    k = min(n, width)
    with np.errstate(over="ignore"):
        s = h[: n - k + 1] * _ODD[0]
        for i in range(1, k):
            s = s + h[i : n - k + 1 + i] * _ODD[i % 64]
        return np.unique(_mix(s + np.uint64(k)))


def minhashes(s: np.ndarray) -> np.ndarray:
    """HASHES minima of 32 bits; `s` isn't empty."""
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(0, len(s), 4096):
            low = np.minimum(low, (np.multiply.outer(s[k : k + 4096], _MUL) + _ADD).min(0))
    return (low >> np.uint64(32)).astype(np.uint32)


def sketch(s: np.ndarray, sig: np.ndarray) -> bytes:
    """A byte of each minhash, and for each bin of the hash range a byte from 1 of its least element (0: none)."""
    edges = np.arange(BINS, dtype=np.uint64) << np.uint64(57)
    first = np.searchsorted(s, edges)
    own = np.minimum(first, len(s) - 1)
    there = (first < len(s)) & ((s[own] >> np.uint64(57)) == np.arange(BINS, dtype=np.uint64))
    return sig.astype(np.uint8).tobytes() + np.where(there, s[own] % np.uint64(255) + np.uint64(1), 0).astype(np.uint8).tobytes()


def alike(x: np.ndarray, y: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(whether the similarity of rows x and y isn't ruled out, share of equal bytes); bins empty in both don't count."""
    same = (x[..., :HASHES] == y[..., :HASHES]).sum(-1)
    u, v = x[..., HASHES:], y[..., HASHES:]
    there = ((u != 0) | (v != 0)).sum(-1)
    same = same + ((u == v) & (u != 0)).sum(-1)
    n, s = HASHES + there, percent / 100
    share = same / n
    return share >= s - 5 * np.sqrt(s * (1 - s) / n), share


def _bytes(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(len(column), HASHES + BINS)


def _print(s: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        f1, f2 = _mix(s ^ _ODD[5]).sum(dtype=np.uint64), _mix(s ^ _ODD[6]).sum(dtype=np.uint64)
    return int(f1.astype(np.int64)), int(f2.astype(np.int64))


def _described(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, t in zip(b.iloc[:, 0], b.iloc[:, 1], strict=True):
                s = shingles(t, width)
                if len(s):
                    sig = minhashes(s)
                    out.append((i, len(s), *_print(s), sig.tobytes(), sketch(s, sig)))
                else:
                    out.append((i, 0, 0, 0, b"", b""))
            yield pd.DataFrame(out, columns=["id", "n", "f1", "f2", "sig", "sketch"])

    return run


def _keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (key, cls, origin): a class under each of its table keys. Rows that a key has beyond SPREAD in this task go to keys
    of their own, with the key they come from as origin."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId() if TaskContext.get() else 0
    hot, number = np.zeros(0, np.uint64), 0
    for whole in batches:
        for at in range(0, len(whole), 5000):
            b, number = whole.iloc[at : at + 5000], number + 1
            sig = np.frombuffer(b"".join(b["sig"]), np.uint32).reshape(len(b), HASHES).astype(np.uint64)
            with np.errstate(over="ignore"):
                a = np.stack([_mix(sig[:, i * RA] * _ODD[7] + sig[:, i * RA + 1] * _ODD[8] + np.uint64(i)) for i in range(TA)], 1)
                o = TA * RA
                c = np.stack([_mix(sig[:, o + j * RB] * _ODD[9] + sig[:, o + j * RB + 1] * _ODD[10] + sig[:, o + j * RB + 2] * _ODD[11] + np.uint64(j)) for j in range(TB)], 1)
                keys = _mix(a[:, :, None] * _ODD[12] + c[:, None, :]).reshape(-1)
                ids = np.repeat(b["cls"].to_numpy(np.int64), TA * TB)
                order = np.argsort(keys, kind="stable")
                keys, ids = keys[order], ids[order]
                first = np.r_[True, keys[1:] != keys[:-1]]
                start = np.maximum.accumulate(np.where(first, np.arange(len(keys)), 0))
                sub = (np.arange(len(keys)) - start) // SPREAD + np.isin(keys, hot)  # a hot key's rows all move from here on
                over = sub > 0
                origin = pd.array(keys.astype(np.int64), dtype="Int64")
                origin[~over] = pd.NA
                if over.any():
                    hot = np.union1d(hot, keys[over])
                    moved = _mix(keys + _mix(sub.astype(np.uint64) * _ODD[13] + np.uint64(part) * _ODD[14] + np.uint64(number) * _ODD[15]))
                    keys = np.where(over, moved, keys)
            yield pd.DataFrame({"key": keys.astype(np.int64), "cls": ids, "origin": origin})


def _met(classes: DataFrame) -> DataFrame:
    """(key, cls, origin, lead) of the buckets with several members: lead is the member, of all buckets of its origin, that
    meets most others over all tables."""
    rows = classes.select("cls", "sig").mapInPandas(_keys, "key long, cls long, origin long")
    rows = rows.withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("key"))).filter((F.col("m") > 1) | F.col("origin").isNotNull())
    rows = staged(rows, "met")
    meetings = rows.groupBy("cls").agg(F.sum("m").alias("meetings"))
    top = rows.join(meetings, "cls").groupBy("key").agg(F.max("origin").alias("origin"), F.max(F.struct("meetings", (-F.col("cls")).alias("c"))).alias("top"))
    top = staged(top.withColumn("origin", F.coalesce("origin", "key")), "top")
    led = top.groupBy("origin").agg(F.max("top").alias("top")).select(F.col("origin").alias("o"), (-F.col("top.c")).alias("lead"))
    leads = staged(top.select("key", "origin").join(led, F.col("origin") == F.col("o")).select("key", "origin", "lead"), "leads")
    discard(top)
    return rows.select("key", "cls").join(leads, "key")


class _Forest(dict):
    """Union-find: unite() tells whether its two roots were apart."""

    def find(self, x: int) -> int:
        while (up := self.get(x, x)) != x:
            self[x] = self.get(up, up)
            x = up
        return x

    def unite(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self[max(x, y)] = min(x, y)
        return x != y


def _links(width: int, percent: int):
    """For a block's rows (side, cls, root, n, f1, f2, text): links between its left and its other members that join roots."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        sets, seen = [], set()
        for row in rows.itertuples(index=False):
            if (row.side, row.cls) in seen:
                continue
            s = shingles(row.text, width)
            if len(s) == row.n and _print(s) == (row.f1, row.f2):  # other versions of the id aren't this class
                seen.add((row.side, row.cls))
                sets.append((row.side, row.cls, row.root, s))
        left, right = ([x for x in sets if x[0] == side] for side in (0, 1))
        found = []
        if left and right:
            values = np.concatenate([s for *_, s in right])
            names, codes = np.unique(values, return_inverse=True)
            sizes = np.array([len(s) for *_, s in right])
            starts = np.r_[0, np.cumsum(sizes)]
            roots = np.array([r for _, _, r, _ in right])
            ids = np.array([c for _, c, _, _ in right])
            forest, mark = _Forest(), np.zeros(len(names), bool)
            for _, cls, root, s in left:
                at = np.minimum(np.searchsorted(names, s), len(names) - 1)
                at = at[names[at] == s]
                near = (100 * np.minimum(sizes, len(s)) >= percent * np.maximum(sizes, len(s))) & (ids != cls)
                apart = {r: forest.find(r) for r in np.unique(roots[near]).tolist()}
                mine = forest.find(root)
                todo = np.flatnonzero(near & np.array([apart.get(r, mine) != mine for r in roots.tolist()]))
                if not len(todo):
                    continue
                mark[at] = True
                if len(todo) * 4 > len(right):
                    common = np.add.reduceat(mark[codes].astype(np.int64), starts[:-1])[todo]
                else:
                    common = np.array([mark[codes[starts[k] : starts[k + 1]]].sum() for k in todo])
                mark[at] = False
                for k in todo[100 * common >= percent * (sizes[todo] + len(s) - common)].tolist():
                    if forest.unite(root, int(roots[k])):
                        found.append((min(cls, int(ids[k])), max(cls, int(ids[k]))))
        return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

    return run


def _confirmed(jobs: DataFrame, classes: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b): links found in the blocks of `jobs`, rows (g, x, y, side, cls, root). Each row's text is read and sent once."""
    jobs = staged(jobs.join(classes.select("cls", "rep", "n", "f1", "f2"), "cls"), "jobs")
    few = F.broadcast(jobs) if jobs.count() <= FEW else jobs
    rows = texts.join(few, texts["id"] == few["rep"]).select("g", "x", "y", "side", "cls", "root", "n", "f1", "f2", "text")
    out = staged(rows.groupBy("g", "x", "y").applyInPandas(_links(width, percent), "a long, b long").distinct(), "links")
    discard(jobs)
    return out


def _nearest(percent: int):
    """Of pairs (cls, lead, s, t), those whose sketches don't rule the similarity out, with the share of equal bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            ok, share = alike(_bytes(p["s"]), _bytes(p["t"]), percent)
            yield pd.DataFrame({"cls": p["cls"].to_numpy()[ok], "lead": p["lead"].to_numpy()[ok], "share": share[ok]})

    return run


def _worth(percent: int):
    """For a block's rows (g, x, y, side, cls, root, n, sketch): those with a partner on the other side, in another component,
    that sizes and sketches don't rule out."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        left, right = rows[rows["side"] == 0], rows[rows["side"] == 1]
        a, b = np.zeros(len(left), bool), np.zeros(len(right), bool)
        if len(left) and len(right):
            x, y = _bytes(left["sketch"]), _bytes(right["sketch"])
            n, m, p, q = left["n"].to_numpy(), right["n"].to_numpy(), left["root"].to_numpy(), right["root"].to_numpy()
            for k in range(len(left)):
                some = np.flatnonzero((q != p[k]) & (100 * np.minimum(m, n[k]) >= percent * np.maximum(m, n[k])))
                some = some[alike(x[k], y[some], percent)[0]]
                a[k] = len(some) > 0
                b[some] = True
        out = pd.concat([left[a], right[b]])
        return out[["g", "x", "y", "side", "cls", "root"]]

    return run


def _blocks(open_: DataFrame, classes: DataFrame) -> DataFrame:
    """(g, x, y, side, cls, root, n, sketch): groups dealt to blocks. Left (side 0) are members outside the group's largest
    component, right all members; x and y number their blocks."""
    c = classes.select("cls", "n", "sketch")
    sizes = open_.join(c.select("cls", "n"), "cls").groupBy("g", "root").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("e"))
    main = F.max(F.struct("m", "e", "root")).alias("main")
    sizes = sizes.groupBy("g").agg(main, F.sum("m").alias("m"), F.sum("e").alias("e"))
    parts = lambda m, e: F.greatest(F.ceil(m / BLOCK_ROWS), F.ceil(e / BLOCK_ELEMENTS), F.lit(1)).cast("int")
    sizes = sizes.select("g", F.col("main.root").alias("main"), parts(F.col("m") - F.col("main.m"), F.col("e") - F.col("main.e")).alias("nx"), parts(F.col("m"), F.col("e")).alias("ny"))
    rows = staged(open_.join(staged(sizes, "sizes"), "g").join(c, "cls"), "members")
    at = lambda k: F.pmod(F.xxhash64("cls"), F.col(k)).cast("int")
    steps = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    rest = ["cls", "root", "n", "sketch"]
    left = rows.filter("root <> main").select("g", at("nx").alias("x"), steps("ny").alias("y"), F.lit(0).alias("side"), *rest)
    right = rows.select("g", steps("nx").alias("x"), at("ny").alias("y"), F.lit(1).alias("side"), *rest)
    return left.unionByName(right)


def near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of `docs`: the smallest id reachable over links of
    100 * intersection >= percent * union between sets of `width`-word shingles."""
    texts = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    seen = staged(texts.mapInPandas(_described(width), "id long, n int, f1 long, f2 long, sig binary, sketch binary"), "described")
    own = seen.filter((F.col("n") > 0) & F.col("id").isNotNull())
    classes = own.groupBy("n", "f1", "f2").agg(F.min("id").alias("rep"), F.min("sig").alias("sig"), F.min("sketch").alias("sketch"))
    classes = staged(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    texts = texts.filter(F.col("id").isNotNull())
    met = staged(_met(classes), "led")
    # each class against the leader that its sketch is nearest to
    c = classes.select("cls", "n", "sketch")
    pairs = met.select("cls", "lead").filter("cls <> lead").distinct()
    pairs = pairs.join(c.select("cls", "n", F.col("sketch").alias("s")), "cls").join(c.select(F.col("cls").alias("lead"), F.col("n").alias("m"), F.col("sketch").alias("t")), "lead")
    pairs = pairs.filter(100 * F.least("n", "m") >= percent * F.greatest("n", "m")).select("cls", "lead", "s", "t")
    pairs = pairs.mapInPandas(_nearest(percent), "cls long, lead long, share double")
    best = staged(pairs.groupBy("cls").agg(F.max(F.struct("share", (-F.col("lead")).alias("l"))).alias("top")).select("cls", (-F.col("top.l")).alias("lead")), "best")
    spread = best.groupBy("lead").agg(F.ceil(F.count(F.lit(1)) / 512).cast("int").alias("ny"))
    member = best.join(spread, "lead").select(F.col("lead").alias("g"), F.lit(0).alias("x"), F.pmod(F.xxhash64("cls"), F.col("ny")).cast("int").alias("y"), F.lit(1).alias("side"), "cls", F.col("cls").alias("root"))
    hub = member.select("g", "x", "y", F.lit(0).alias("side"), F.col("g").alias("cls"), F.col("g").alias("root")).distinct()
    links = _confirmed(hub.unionByName(member), classes, texts, width, percent)
    versions = own.groupBy("id").agg(F.min(F.struct("n", "f1", "f2")).alias("lo"), F.max(F.struct("n", "f1", "f2")).alias("hi")).filter("lo <> hi").select("id")
    versions = staged(own.select("id", "n", "f1", "f2").join(versions, "id").distinct().join(classes.select("n", "f1", "f2", "cls"), ["n", "f1", "f2"]).select("id", "cls"), "versions")
    links = links.union(versions.join(versions.groupBy("id").agg(F.min("cls").alias("a")), "id").filter("a <> cls").select("a", F.col("cls").alias("b")))
    roots = contracted(links)
    # buckets that still hold several components
    inside = staged(met.join(roots, F.col("cls") == F.col("id"), "left").select("origin", "cls", "lead", F.coalesce("root", "cls").alias("root")), "inside")
    several = inside.groupBy("origin").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("origin")
    open_ = staged(inside.join(several, "origin", "left_semi").select(F.col("lead").alias("g"), "cls", "root").distinct(), "open")
    discard(met, inside)
    if not open_.isEmpty():
        worth = _blocks(open_, classes).groupBy("g", "x", "y").applyInPandas(_worth(percent), "g long, x int, y int, side int, cls long, root long")
        worth = staged(worth, "worth")
        if not worth.isEmpty():
            links = links.union(_confirmed(worth, classes, texts, width, percent))
            roots = contracted(links)
    reps = classes.select("cls", "n", "f1", "f2", "rep").join(roots, F.col("cls") == F.col("id"), "left").select("n", "f1", "f2", "rep", F.coalesce("root", "cls").alias("root"))
    names = reps.groupBy("root").agg(F.min("rep").alias("component"))
    of = reps.join(names, "root").select("n", "f1", "f2", "component")
    out = seen.select("id", "n", "f1", "f2").join(of, ["n", "f1", "f2"], "left")
    out = out.select(F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"), "n", "component")
    blank = seen.filter((F.col("n") == 0) & F.col("id").isNotNull()).select("id").distinct()
    blank = staged(own.join(blank, "id", "left_semi").join(of, ["n", "f1", "f2"]).groupBy("id").agg(F.min("component").alias("of_id")), "blank")
    if not blank.isEmpty():  # an id with a text and an empty version too: one component
        out = out.join(blank, F.col("doc_id") == F.col("id"), "left").withColumn("component_id", F.when(F.col("n") == 0, F.coalesce("of_id", "component_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id")


def kept(component: Column, key: Column) -> Column:
    return key.eqNullSafe(component)


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents that stay, one id of each component, with the same columns (five-word shingles, similarity 0.8)."""
    c = free_name(docs, "component_id")
    gone = near_duplicates(docs).filter(~kept(F.col("component_id"), F.col("doc_id"))).select(F.col("doc_id").alias(c)).distinct()
    gone = staged(gone, "gone")
    return docs.join(gone, docs["doc_id"] == gone[c], "left_anti")


def op6_tensored_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links all documents at four-word shingles and similarity 0.8."""
    found = near_duplicates(table(spark, sf_dir, "documents"), width=4)
    return found.withColumn("kept", kept(F.col("component_id"), F.col("doc_id")))
