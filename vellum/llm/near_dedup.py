"""Near-duplicate documents by SetSketch registers.

A document's set of word shingles is sketched into registers that hold truncated, exponentially spaced minima
(sketches merge by maximum). Runs of registers are bands: documents that share a band are candidates. The Jaccard
similarity of a candidate pair is estimated jointly by maximum likelihood from how many registers are above, below and
equal; pairs that can pass are verified on their whole sets.

Scale: documents with equal sets are one class from the start, so a group of copies costs one sketch. Classes are
numbered at random, so the smallest and the largest of a band's group are two hubs drawn by lot, which partial
aggregates find. Pairs aren't enumerated: every member is compared with a hub, and linked ones are contracted into
components; of groups that then hold several, members outside the second hub's component are compared with it. Groups that still hold several components go into tiles of bounded size, in which the smaller components'
members are compared with all others, and which give a forest of links, not pairs. Whole sets are made once, and only
of the classes that share a band; their texts are sieved by a Bloom filter before they are shuffled (within
``SIEVE_BYTES``; with more classes the filter lets other texts through as well, never fewer). The joins that move sets
are merge joins at every size, so a hub of very many members is a skewed join, which Spark splits. Links lost by
banding at similarity 0.8: (1 - 0.8**4)**32 = 5e-8 of them; the estimate's margin is six standard deviations.

Defined cases: null and empty texts have an empty set and no links; a null id has no links and a null component; rows
that share an id are documents of their own, each with its own text's links; repeated rows are copies of each other
under one id, so all are kept by ``near_duplicates`` (id and component agree) and one by ``deduplicated``; an empty
table gives an empty result; further columns are not looked at by ``near_duplicates`` and kept by ``deduplicated``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import Bloom
from .common import written
from .components import components, forest
from .textkit import lowered, mixed, raw, released, slices, text_column, word_hashes, words

#: Registers, registers of a band, base and rate of the sketch.
REGISTERS, BAND, BASE, RATE = 128, 4, 1.001, 20.0
#: Members, and shingles, of one side of a tile.
TILE, TILE_SHINGLES = 2048, 2_000_000
#: Below the threshold by less than this, an estimate doesn't rule a pair out.
MARGIN = 0.22
#: Of the filter that texts pass before they are shuffled.
SIEVE_BYTES = 32 << 20

_rng = np.random.default_rng(8)
_A = _rng.integers(0, 2**63, REGISTERS, dtype="u8") * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, REGISTERS, dtype="u8")


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles (64-bit hashes, ascending) of all texts, and where each text's begin and end."""
    data, at = raw(texts)
    data = lowered(data)
    begin, end, first = words(data, at)
    h = word_hashes(data, begin, end)
    sets = []
    for lo, hi in zip(first[:-1], first[1:], strict=True):
        own, n = h[lo:hi], min(k, hi - lo)
        if not n:
            sets.append(np.zeros(0, dtype="u8"))
            continue
        x = np.full(len(own) - n + 1, n, dtype="u8")
        for j in range(n):
            x = mixed(x + own[j : len(own) - n + 1 + j])
        sets.append(np.unique(x))
    ends = np.cumsum([0, *map(len, sets)])
    return np.concatenate(sets) if sets else np.zeros(0, dtype="u8"), ends


def registers(elements: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One row of 16-bit registers for each set: floor(1 - log_b(h)) of the smallest exponential h, from 0 to 2**16 - 1."""
    out = np.zeros((len(ends) - 1, REGISTERS), dtype="u2")
    full = np.flatnonzero(ends[1:] > ends[:-1])
    if len(full):
        least = np.empty((REGISTERS, len(full)), dtype="u8")
        for i in range(REGISTERS):
            least[i] = np.minimum.reduceat(elements * _A[i] + _B[i], ends[:-1][full])
        h = -np.log1p(-(least.T.astype("f8") + 0.5) / 2.0**64) / RATE
        out[full] = np.clip(np.floor(1 - np.log(h) / np.log(BASE)), 0, 2**16 - 1).astype("u2")
    return out


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of the union of two sets."""
    return np.maximum(a, b)


def likeliest(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """For rows of registers of sets of known sizes: the Jaccard similarity with the greatest likelihood, in hundredths."""
    above, below = (a > b).sum(1), (a < b).sum(1)
    equal = a.shape[1] - above - below
    u = (n_a / (n_a + n_b))[:, None]
    j = np.linspace(0, 1, 101)[None]
    with np.errstate(divide="ignore", invalid="ignore"):
        p = -np.log1p(-np.clip(u - (1 - u) * j, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
        q = -np.log1p(-np.clip(1 - u - u * j, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
        parts = [np.where(n[:, None] > 0, n[:, None] * np.log(np.maximum(x, 1e-12)), 0) for n, x in ((above, p), (below, q), (equal, 1 - p - q))]
    fits = (j <= np.minimum(u / (1 - u), (1 - u) / u) + 0.005) | (j == 0)
    return np.where(fits, sum(parts), -np.inf).argmax(1) / 100


def _sketches(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_column(batch.column(2))
            for lo, hi in slices(texts):
                x, ends = shingle_sets(texts.slice(lo, hi - lo), k)
                total = [np.concatenate((np.zeros(1, dtype="u8"), np.cumsum(mixed(x ^ np.uint64(c)), dtype="u8"))) for c in (1, 2)]
                sig = [(t[ends[1:]] - t[ends[:-1]]).view("i8") for t in total]
                regs = registers(x, ends)
                at = np.arange(len(regs) + 1, dtype="i4") * (2 * REGISTERS)
                held = pa.Array.from_buffers(pa.binary(), len(regs), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(regs.astype("<u2").tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).slice(lo, hi - lo) for c in (0, 1)], pa.array(np.diff(ends)), pa.array(sig[0]), pa.array(sig[1]), held],
                    ["doc_id", "digest", "n_shingles", "sig_a", "sig_b", "registers"],
                )
        released()

    return run


def _sources(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, digest (a hash of the text as it is), text; a row's first two stand for it wherever texts needn't go."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("digest"), text.alias("text"))


def sketches(docs: DataFrame, *, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, digest (of the text), n_shingles, sig_a, sig_b (a digest of the set), registers."""
    return _sources(docs, id_col, text_col).mapInArrow(_sketches(k), "doc_id long, digest long, n_shingles long, sig_a long, sig_b long, registers binary")


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = REGISTERS // BAND
        keys = _rows(batch.column(1)).view("<u8")
        keys = mixed(keys + mixed(np.arange(n, dtype="u8"))[None])
        yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view("i8")), pa.array(np.repeat(batch.column(0).to_numpy(), n))], ["key", "id"])


def _rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u2").reshape(-1, REGISTERS)


def _with_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_column(batch.column(3))
            for lo, hi in slices(texts):
                x, ends = shingle_sets(texts.slice(lo, hi - lo), k)
                sets = pa.array([x[a:b].astype("<u8").tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(lo, hi - lo) for c in range(3)], sets], ["id", "n_shingles", "registers", "set"])
        released()

    return run


def _verified(percent: int):
    """Of pairs (two ids, sizes, registers and sets) those that the estimate doesn't rule out and whose sets are near."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 2000):
                part = batch.slice(at, 2000)
                n_a, n_b = (part.column(c).to_numpy().astype("f8") for c in ("n_a", "n_b"))
                ok = likeliest(_rows(part.column("reg_a")), _rows(part.column("reg_b")), n_a, n_b) >= percent / 100 - MARGIN
                for i in np.flatnonzero(ok):
                    x, y = (np.frombuffer(part.column(c)[int(i)].as_buffer(), dtype="<u8") for c in ("set_a", "set_b"))
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    ok[i] = 100 * both >= percent * (len(x) + len(y) - both)
                yield pa.RecordBatch.from_arrays([part.column(c).filter(pa.array(ok)) for c in ("a", "b")], ["a", "b"])
        released()

    return run


def _links(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """pairs (id, hub) to links (a, b). A member's set goes to its hub, whose own is read once for all of them."""
    sized = members.select("id", "n_shingles")
    near = lambda x, y: 100 * F.col(x) >= percent * F.col(y)
    pairs = pairs.join(sized.withColumnRenamed("n_shingles", "n_a"), "id").join(sized.withColumnsRenamed({"id": "hub", "n_shingles": "n_b"}), "hub")
    pairs = pairs.where(near("n_a", "n_b") & near("n_b", "n_a")).select("id", "hub")
    own = members.withColumnsRenamed({"n_shingles": "n_a", "registers": "reg_a", "set": "set_a"})
    hubs = members.withColumnsRenamed({"id": "hub", "n_shingles": "n_b", "registers": "reg_b", "set": "set_b"})
    both = pairs.hint("merge").join(own, "id").hint("merge").join(hubs, "hub")
    both = both.select(F.col("id").alias("a"), F.col("hub").alias("b"), "n_a", "n_b", "reg_a", "reg_b", "set_a", "set_b")
    return written(both.mapInArrow(_verified(percent), "a long, b long"), "verified")


def _open_groups(bands: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of groups of three or more that hold several components: key, id, far, component, lead (the largest component), beyond (far's component).

    What a group holds is counted by component first, so a group of very many members in few components is a few rows.
    """
    own = bands.join(labels.select(F.col("node").alias("id"), "component"), "id", "left")
    own = written(own.select("key", "id", "far", F.coalesce("component", "id").alias("component")), "labelled")
    counted = own.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top"))
    groups = counted.groupBy("key").agg(
        F.count(F.lit(1)).alias("c"), F.sum("n").alias("many"), F.max(F.struct("n", (-F.col("component")).alias("c"))).alias("l"), F.max(F.struct("top", "component")).alias("f")
    )
    groups = written(groups.where("many > 2 and c > 1").select("key", (-F.col("l.c")).alias("lead"), F.col("f.component").alias("beyond")), "open-keys")
    return written(own.join(groups, "key"), "open")


def _far_pairs(left: DataFrame) -> DataFrame:
    """id, hub: members of open groups with their second hub, but for those that are in its component already, to which a link adds nothing."""
    return left.where("component <> beyond").select("id", F.col("far").alias("hub")).distinct()


def _tiles(left: DataFrame, members: DataFrame) -> DataFrame:
    """Open groups to tiles: lead, kind, p, q, part, id, component.

    Groups with the same largest component are one, led by it, so members come once and not once a band. Its other
    members, few as a rule, are what has to be compared: with each other (kind 0) and with the leading component's
    (kind 1), in tiles of at most about two times TILE members, or TILE_SHINGLES shingles.
    """
    own = written(left.select("lead", "id", "component").distinct().join(members.select("id", "n_shingles"), "id"), "tile-members")
    other = F.col("component") != F.col("lead")
    parts = lambda which: F.ceil(F.greatest(F.sum(which.cast("int")) / TILE, F.sum(F.when(which, F.col("n_shingles")).otherwise(0)) / TILE_SHINGLES)).cast("int")
    sizes = written(own.groupBy("lead").agg(parts(other).alias("s"), parts(~other).alias("g")), "tile-sizes")  # a row a group, so a large one's join is Spark's to split
    own = own.join(sizes, "lead").withColumn("part", F.pmod(F.xxhash64("id"), F.when(other, F.col("s")).otherwise(F.col("g"))).cast("int"))
    among = F.transform(F.sequence(F.lit(0), F.col("s") - 1), lambda j: F.struct(F.lit(0).alias("kind"), F.least("part", j).alias("p"), F.greatest("part", j).alias("q")))
    down = F.transform(F.sequence(F.lit(0), F.col("s") - 1), lambda j: F.struct(F.lit(1).alias("kind"), j.alias("p"), F.col("part").alias("q")))
    across = F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda j: F.struct(F.lit(1).alias("kind"), F.col("part").alias("p"), j.alias("q")))
    return own.select("lead", "id", "component", "part", other.alias("other"), F.inline(F.when(other, F.concat(among, across)).otherwise(down)))


def shared_counts(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, columns: int = 256) -> np.ndarray:
    """How many elements each set of a shares with each of b: products of incidence matrices, some elements at a time."""
    values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype="i4"), [len(x) for x in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    first = np.append(True, values[1:] != values[:-1])
    many = np.diff(np.append(np.flatnonzero(first), len(values)))
    keep = np.repeat(many > 1, many)  # an element of one set isn't shared
    code = np.cumsum(first[keep], dtype="i4") - 1
    owner = owner[keep]
    out = np.zeros((len(a), len(b)), dtype="f4")  # counts below 2**24 are exact
    for lo in range(0, int(code[-1]) + 1 if len(code) else 0, columns):
        i, j = np.searchsorted(code, [lo, lo + columns])
        m = np.zeros((len(sets), columns), dtype="f4")
        m[owner[i:j], code[i:j] - lo] = 1
        out += m[a] @ m[b].T
    return out


def reaches(above: np.ndarray, below: np.ndarray, equal: np.ndarray, u: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the similarity with the greatest likelihood is the threshold or more, for counts of registers.

    The logarithm of the likelihood is concave in the similarity, so it is if it doesn't fall on the last hundredth
    below the threshold. u is the first set's share of both sizes; sizes that allow the threshold are assumed.
    """
    change = np.zeros(above.shape)
    for j, sign in ((threshold, 1), (threshold - 0.01, -1)):
        p = -np.log1p(-np.clip(u - (1 - u) * j, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)
        q = -np.log1p(-np.clip(1 - u - u * j, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)
        change += sign * (above * np.log(p) + below * np.log(q) + equal * np.log(np.maximum(1 - p - q, 1e-12)))
    return change >= 0


def _estimated(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, threshold: float) -> np.ndarray:
    """For rows of registers of two sides: which pairs the estimate doesn't rule out; some rows at a time."""
    out = np.zeros((len(a), len(b)), dtype=bool)
    for lo in range(0, len(a), 128):
        x, n = a[lo : lo + 128], n_a[lo : lo + 128, None]
        equal, above = np.zeros((2, len(x), len(b)), dtype="u1")
        for r in range(a.shape[1]):
            equal += x[:, r][:, None] == b[:, r][None]
            above += x[:, r][:, None] > b[:, r][None]
        near = (n >= threshold * n_b[None] - 1e-9) & (n_b[None] >= threshold * n - 1e-9)
        i, j = np.nonzero(near & (equal >= (threshold - MARGIN) * a.shape[1]))  # a similarity is at most the share of equal ones
        e, v = equal[i, j].astype("f8"), above[i, j].astype("f8")
        out[lo + i, j] = reaches(v, a.shape[1] - e - v, e, n[i, 0] / (n[i, 0] + n_b[j]), threshold - MARGIN)
    return out


def _tile_links(percent: int):
    def run(tile: pa.Table) -> pa.Table:
        ids, comp, part, other, n = (tile.column(c).to_numpy() for c in ("id", "component", "part", "other", "n_shingles"))
        kind, p, q = (tile.column(c)[0].as_py() for c in ("kind", "p", "q"))
        a, b = (np.flatnonzero(other), np.flatnonzero(~other)) if kind else (np.flatnonzero(part == p), np.flatnonzero(part == q))
        found: list[tuple[int, int]] = []
        if len(a) and len(b):
            n = n.astype("f8")
            likely = _estimated(_rows(tile.column("registers").take(pa.array(a))), _rows(tile.column("registers").take(pa.array(b))), n[a], n[b], percent / 100)
            likely &= comp[a][:, None] != comp[b][None]
            a, b, likely = a[x := likely.any(1)], b[y := likely.any(0)], likely[x][:, y]
            used = np.union1d(a, b)
            if len(used):
                sets = [np.frombuffer(tile.column("set")[int(i)].as_buffer(), dtype="<u8") for i in used]
                both = shared_counts(sets, np.searchsorted(used, a), np.searchsorted(used, b))
                for i in range(len(a)):
                    own = np.flatnonzero(likely[i] & (100 * both[i].astype("f8") >= percent * (n[a[i]] + n[b] - both[i])))
                    found += [(int(ids[a[i]]), int(x)) for x in ids[b[own]]]
                    if len(found) > 50_000:  # a forest of them says the same
                        found = [(x, r) for x, r in forest(found).items() if x != r]
        stars = [(x, r) for x, r in forest(found).items() if x != r]
        out = pa.table({"a": pa.array([x for x, _ in stars], pa.int64()), "b": pa.array([r for _, r in stars], pa.int64())})
        released()
        return out

    return run


_SET = ["n_shingles", "sig_a", "sig_b"]


def _classified(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """One row a document: doc_id, digest, n_shingles, and keep, the smallest (doc_id, digest) that it reaches; null if it has no links to look for."""
    sketched = written(sketches(docs, k=k, id_col=id_col, text_col=text_col), "sketches")
    real = sketched.where("n_shingles > 0 and doc_id is not null")
    classes = real.groupBy(*_SET).agg(F.min(F.struct("doc_id", "digest")).alias("row"), F.first("registers").alias("registers"))
    # classes are numbered at random: the number is made of a written row's place, so it's unique and stays
    placed = written(classes.select(*_SET, "row", "registers"), "classes").withColumn("id", F.xxhash64(F.monotonically_increasing_id()))
    classes = written(placed, "numbered")
    bands = classes.select("id", "registers").mapInArrow(_bands, "key long, id long")
    hubs = written(bands.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("far")).where("hub < far"), "hubs")
    bands = written(bands.join(hubs, "key"), "bands")
    members = _members(docs, classes, bands, k, id_col, text_col)
    links = _links(bands.where("id <> hub").select("id", "hub").distinct(), members, percent)
    labels = components(links)
    left = _open_groups(bands, labels)
    if left.head(1):
        members = sieved(members, left.select("id").distinct(), ["id"])[0]
        links = links.union(_links(_far_pairs(left), members, percent))
        labels = components(links)
        left = _open_groups(left.select("key", "id", "far"), labels)
    if left.head(1):
        members = sieved(members, left.select("id").distinct(), ["id"])[0]
        held = written(_tiles(left, members), "tiles").hint("merge").join(members, "id")
        links = links.union(held.groupBy("lead", "kind", "p", "q").applyInArrow(_tile_links(percent), "a long, b long"))
        labels = components(links)
    known = classes.select("id", *_SET, "row").join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    keep = known.groupBy("component").agg(F.min("row").alias("keep"))
    known = written(known.join(keep, "component").select(*_SET, "keep"), "known")
    out = sketched.drop("registers").join(known, _SET, "left")
    return out.select("doc_id", "digest", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("keep")).alias("keep"))


def _members(docs: DataFrame, classes: DataFrame, bands: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """id, n_shingles, registers, set of each class that shares a band, the set made again from one of its texts."""
    wanted = classes.hint("merge").join(bands.select("id").distinct(), "id", "left_semi")
    wanted = written(wanted.select("row.doc_id", "row.digest", "id", "n_shingles", "registers"), "wanted")
    texts = sieved(_sources(docs, id_col, text_col), wanted, ["doc_id", "digest"])[0]
    texts = texts.groupBy("doc_id", "digest").agg(F.first("text").alias("text"))  # repeated rows are merged before they move
    held = wanted.hint("merge").join(texts, ["doc_id", "digest"]).select("id", "n_shingles", "registers", "text")
    return written(held.mapInArrow(_with_sets(k), "id long, n_shingles long, registers binary, set binary"), "members")


def sieved(rows: DataFrame, wanted: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """rows that may have a key of wanted's, and those that don't, by a Bloom filter."""
    hashed = F.xxhash64(*key)
    bloom = Bloom.sized(max(1, wanted.count()), 0.01, most_bytes=SIEVE_BYTES).built(wanted.select(hashed.alias("key")))
    may = bloom.holds(hashed)
    return rows.where(may), rows.where(~may)


def near_duplicates(docs: DataFrame, *, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (smallest id it reaches by links), kept.

    Links are pairs with a Jaccard similarity of ``percent`` hundredths or more between their sets of k-word shingles.
    """
    out = _classified(docs, k, percent, id_col, text_col)
    out = out.select("doc_id", "n_shingles", F.coalesce("keep.doc_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, *, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: the smallest id, of its texts the one with the smallest hash, once.

    Rows without words and rows with a null id have no links and stay. Only rows that a filter takes for ones with
    something to decide are shuffled.
    """
    found = _classified(docs, k, percent, id_col, text_col).where("keep is not null")
    counted = found.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("many"), F.min((F.col("keep.doc_id") == F.col("doc_id")) & (F.col("keep.digest") == F.col("digest"))).alias("stays"))
    decided = written(counted.where("not stays or many > 1").select(F.col("doc_id").alias("id_"), F.col("digest").alias("digest_"), "stays"), "decided")
    own = docs.select(F.struct("*").alias("row_"), F.col(id_col).cast("long").alias("id_"), F.xxhash64(F.col(text_col).cast("string")).alias("digest_"))
    key = ["id_", "digest_"]
    may, rest = sieved(own, decided, key)
    out = rest.select("row_").unionByName(may.hint("merge").join(decided, key, "left_anti").select("row_"))
    once = decided.where("stays").drop("stays")
    if once.head(1):
        out = out.unionByName(may.join(once, key, "left_semi").groupBy(*key).agg(F.first("row_").alias("row_")).select("row_"))
    return out.select("row_.*")
