"""Near-duplicate classes by b-bit MinHash, confirmed on whole shingle sets.

1. One pass over the texts: each document's set of word shingles, its size, a
   digest, ``PERMS`` minima, of which ``BITS`` low bits are kept and packed,
   and ``BANDS`` band hashes of ``ROWS`` minima.
2. Documents of one set are one copy class, represented by its smallest id.
3. Representatives that share a band fall into families (connected components
   of the links of each bucket's members to its smallest: linear in members).
4. In each family, pairs whose collision-corrected similarity, a bit count of
   packed signatures, is near the threshold are confirmed on whole sets; pairs
   already connected are passed over, so at most one link a member is kept.
   A large family is cut into blocks, and pairs of blocks are spread over tasks.
5. Classes are the connected components of confirmed links and copy classes.

A pair at the threshold of 0.85 shares no band with a probability of 4e-7.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._graph import components
from ._store import cut, drop
from ._text import SPACE, blocks, gram_hash, mix, words

SHINGLE = 5
BANDS, ROWS, PERMS, BITS = 25, 5, 128, 2
#: A pair is compared on whole sets if its estimate is at most this far below the threshold (six standard errors).
SLACK = 0.25
#: A family has at least this many members a block, at most so many blocks, and never more shingles a block.
BLOCK_ROWS, BLOCK_COUNT, BLOCK_SHINGLES = 128, 16, 2_000_000
CHUNK = 1 << 15

_rng = np.random.default_rng(9)
_MUL = _rng.integers(0, 2**32, PERMS, dtype=np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 2**32, PERMS, dtype=np.uint32)
_BAND = _rng.integers(0, 2**64, (BANDS, ROWS + 1), dtype=np.uint64) | np.uint64(1)

SIGNED = "doc_id long, n_shingles long, d1 long, d2 long, sig binary, bands array<long>"


def shingle_sets(raw: np.ndarray, at: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(48-bit hashes, first index of each text and the end) of the texts' shingle sets, in order.

    A text with fewer than k words, but not none, has its whole sequence as its one shingle.
    """
    w = words(raw, at, SPACE)
    n = np.diff(w.first)
    i = np.arange(max(0, len(w.doc) - k + 1))
    i = i[w.doc[i] == w.doc[i + k - 1]]
    doc, h = w.doc[i], gram_hash(w.hash, k)[i]
    for m in range(1, k):
        few = np.flatnonzero(n == m)
        if len(few):
            doc = np.concatenate([doc, few])
            h = np.concatenate([h, gram_hash(w.hash, m)[w.first[few]]])
    key = (doc.astype(np.uint64) << np.uint64(48)) | (h >> np.uint64(16))
    key.sort()
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    first = np.searchsorted(key, np.arange(len(at), dtype=np.uint64) << np.uint64(48))
    return key & np.uint64((1 << 48) - 1), first


def signatures(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Minima of PERMS hash functions over each set; rows of empty sets are all ones."""
    m = len(first) - 1
    out = np.full((m, PERMS), 0xFFFFFFFF, np.uint32)
    base = mix(h).astype(np.uint32)
    doc = 0
    full = np.flatnonzero(np.diff(first))
    while doc < len(full):
        lo = first[full[doc]]
        end = max(doc + 1, int(np.searchsorted(first[full], lo + CHUNK)))
        rows = full[doc:end]
        part, at = base[lo : first[rows[-1] + 1]], first[rows] - lo
        for j in range(PERMS):
            out[rows, j] = np.minimum.reduceat(part * _MUL[j] + _ADD[j], at)
        doc = end
    return out


def pack(minima: np.ndarray) -> np.ndarray:
    """The low BITS bits of each (mixed) minimum, packed into 64-bit words."""
    low = (minima * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
    bits = np.zeros((len(minima), PERMS * BITS), np.uint8)
    for b in range(BITS):
        bits[:, b::BITS] = (low >> np.uint32(b)) & np.uint32(1)
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def similarity(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Estimates corrected for chance agreement of b-bit minima: (p - 2^-b) / (1 - 2^-b)."""
    x = one ^ many
    odd = x.copy()
    for b in range(1, BITS):
        odd |= x >> np.uint64(b)
    mask = np.uint64(sum(1 << i for i in range(0, 64, BITS)))
    unlike = np.bitwise_count(odd & mask).sum(axis=-1)
    chance = 2.0**-BITS
    return (1 - unlike / PERMS - chance) / (1 - chance)


def band_hashes(minima: np.ndarray) -> np.ndarray:
    """A hash for each band, different from all other bands' hashes."""
    rows = minima[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS).astype(np.uint64)
    return mix((rows * _BAND[None, :, :ROWS]).sum(axis=2, dtype=np.uint64) + _BAND[None, :, ROWS])


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, raw, at in blocks(batch.column(1)):
            h, first = shingle_sets(raw, at)
            n = np.diff(first)
            full = n > 0
            digest = []
            for salt in (0x1234567, 0x89ABCDEF01):
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ np.uint64(salt << 20)), dtype=np.uint64)])
                digest.append((total[first[1:]] - total[first[:-1]]).view(np.int64))
            minima = signatures(h, first)
            sig = pack(minima)
            bands = band_hashes(minima).view(np.int64)[full]
            ends = np.concatenate([[0], np.cumsum(full)]) * BANDS
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(lo, hi - lo).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(digest[0]), pa.array(digest[1]),
                    pa.array([x.tobytes() for x in sig], pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(bands.ravel())),
                ],
                ["doc_id", "n_shingles", "d1", "d2", "sig", "bands"],
            )


class _Forest:
    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: int, b: np.ndarray) -> np.ndarray:
        """Joins a with all of b; those of b that link trees not yet joined."""
        roots, first = np.unique(self.root[b], return_index=True)
        new = roots != self.root[a]
        if new.any():
            self.root[np.isin(self.root, roots[new])] = self.root[a]
        return b[first[new]]


def links_of(table: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links enough to connect what pairs of one task connect, confirmed on whole sets.

    ``table``: rep, text, sig, mine (0 or 1; if both occur, only pairs of unlike mine count).
    """
    rep = table["rep"].to_numpy()
    mine = table["mine"].to_numpy()
    order = np.lexsort((rep, mine))
    table, rep, mine = table.take(pa.array(order)), rep[order], mine[order]
    sets, size = [], []
    for _, _, raw, at in blocks(table["text"].combine_chunks()):
        h, first = shingle_sets(raw, at)
        sets.append(h)
        size.append(np.diff(first))
    h, size = np.concatenate(sets), np.concatenate(size)
    first = np.concatenate([[0], np.cumsum(size)])
    sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint64).reshape(len(rep), -1)
    _, ids = np.unique(h, return_inverse=True)
    mark = np.zeros(ids.max(initial=0) + 1, np.int32)
    crossing = mine[0] != mine[-1]
    split = int(np.searchsorted(mine, 1)) if crossing else len(rep)
    forest, us, vs = _Forest(len(rep)), [], []
    floor = percent / 100 - SLACK
    for a in range(split):
        others = np.arange(split, len(rep)) if crossing else np.arange(a + 1, len(rep))
        others = others[forest.root[others] != forest.root[a]]
        lo, hi = np.minimum(size[others], size[a]), np.maximum(size[others], size[a])
        others = others[100 * lo >= percent * hi]
        others = others[similarity(sig[a], sig[others]) >= floor]
        if not len(others):
            continue
        own = ids[first[a] : first[a + 1]]
        mark[own] = 1
        n = size[others]
        ends = np.cumsum(n)
        at = np.repeat(first[others] - ends + n, n) + np.arange(ends[-1])
        both = np.add.reduceat(mark[ids[at]], ends - n)
        mark[own] = 0
        linked = others[100 * both >= percent * (size[a] + n - both)]
        if len(linked):
            new = forest.join(a, linked)
            us.append(np.full(len(new), rep[a]))
            vs.append(rep[new])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *us]), np.concatenate([none, *vs])


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Documents are linked if 100 * |A and B| >= percent * |A or B| for their
    sets of distinct five-word shingles (percent >= 80); component_id is the
    smallest doc_id reachable. Null, empty and blank texts have no shingles and
    are linked with nothing. Texts of fewer than five words have one shingle,
    the whole sequence. Rows with a null id are left out. Repeated rows are
    each returned, with one component. Other columns are not read. Texts are
    whole; families of any size are compared in full.
    """
    if not 80 <= percent <= 100:
        raise ValueError("percent is 80 to 100")
    docs = docs.where(docs["doc_id"].isNotNull()).select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    signed, _ = cut(docs.mapInArrow(_sign, SIGNED))
    some = signed.where("n_shingles > 0")
    classes = some.groupBy("d1", "d2", F.col("n_shingles").alias("n")).agg(F.min("doc_id").alias("rep"))
    members = signed.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "bands").dropDuplicates(["doc_id"])
    banded = members.select("doc_id", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("doc_id").alias("v"), F.count("*").alias("c")).where("c > 1").select("band", "v")
    family, family_path = components(banded.join(buckets, "band").select(F.col("doc_id").alias("u"), "v"))
    family = family.select(F.col("node").alias("rep"), F.col("root").alias("family"))
    family = family.join(signed.select(F.col("doc_id").alias("rep"), "sig", "n_shingles").dropDuplicates(["rep"]), "rep")
    by_rows = F.least(F.ceil(F.count("*") / F.lit(BLOCK_ROWS)), F.lit(BLOCK_COUNT))
    count = family.groupBy("family").agg(F.greatest(by_rows, F.ceil(F.sum("n_shingles") / F.lit(BLOCK_SHINGLES))).cast("int").alias("blocks"))
    # Dealt out anew, so that the join shuffles both sides itself and a large family can be split.
    count = count.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = family.join(count, "family").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    held = placed.join(docs.select(F.col("doc_id").alias("rep"), "text"), "rep")
    dealt = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "family", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "rep", "text", "sig", (F.col("block") > F.col("other")).cast("int").alias("mine"))

    def confirm(table: pa.Table) -> pa.Table:
        if table.num_rows < 2:
            return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})
        u, v = links_of(table, percent)
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    confirmed = dealt.groupBy("family", "i", "j").applyInArrow(confirm, "u long, v long")
    label, _ = components(confirmed)
    drop(docs.sparkSession, family_path)
    roots = classes.join(label.select(F.col("node").alias("rep"), "root"), "rep", "left").select("d1", "d2", "n", F.coalesce("root", "rep").alias("root"))
    out = signed.join(roots, [signed["d1"] == roots["d1"], signed["d2"] == roots["d2"], signed["n_shingles"] == roots["n"]], "left")
    component = F.coalesce(F.col("root"), F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (component == F.col("doc_id")).alias("kept"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all ``documents`` at a Jaccard similarity of 0.85."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP9_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{20}\x{09}-\x{0D}]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 4], ' ')) AS g FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n, sum(g) AS d1, bit_xor(hash(g)) AS d2 FROM s GROUP BY doc_id),
c AS (SELECT n, d1, d2, min(doc_id) AS rep FROM n GROUP BY ALL),
r AS (SELECT s.doc_id, s.g, c.n FROM s JOIN c ON s.doc_id = c.rep),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k, any_value(a.n) AS nu, any_value(b.n) AS nv FROM r a JOIN r b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY 1, 2),
e AS (SELECT u, v FROM p WHERE 100 * k >= 85 * (nu + nv - k) UNION ALL SELECT v, u FROM p WHERE 100 * k >= 85 * (nu + nv - k)),
walk(a, b) AS (SELECT u, u FROM e UNION SELECT walk.a, e.v FROM walk JOIN e ON walk.b = e.u),
root AS (SELECT a, min(b) AS root FROM walk GROUP BY a),
f AS (SELECT n.doc_id, n.n, coalesce(root.root, c.rep) AS root FROM n JOIN c USING (n, d1, d2) LEFT JOIN root ON c.rep = root.a)
SELECT d.doc_id, CAST(coalesce(f.n, 0) AS BIGINT) AS n_shingles, coalesce(f.root, d.doc_id) AS component_id, coalesce(f.root, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN f USING (doc_id)
"""

QUERIES = {"op9_near_dedup": op9_near_dedup}
ORACLES = {"op9_near_dedup": OP9_SQL}
