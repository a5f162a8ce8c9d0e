"""How far the variants of a group differ."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.weights import plain
from quillon.operators import blocks
from quillon.operators.blocks import ByTerm, nearest
from quillon.operators.index import BROADCAST_ROWS, Index, terms_of, variants
from quillon.plans.checkpoints import plain_unions
from quillon.plans.shipping import ship

#: Variants of a block, at most about; a smaller group has up to ``SHARES`` blocks of at least ``LEAST``, so that several tasks share it.
BLOCK, SHARES, LEAST = 8_000, 4, 500
#: Rows of a batch of pairs.
BATCH = 200_000


@dataclass(frozen=True)
class Divergence:
    variants: DataFrame
    matrix: DataFrame
    centroid_terms: DataFrame
    summary: DataFrame


@dataclass(frozen=True)
class Group:
    """Variants in an order, with their vectors of plain weights."""

    ids: pa.Array
    seq: np.ndarray
    vectors: ByTerm
    norm: np.ndarray
    terms: np.ndarray

    def part(self, at: int, to: int) -> Group:
        return Group(self.ids[at:to], self.seq[at:to], self.vectors.part(at, to), self.norm[at:to], self.terms[at:to])


@dataclass(frozen=True)
class Tile:
    """Cosines of the variants ``i:`` of one group with ``j:`` of another; ``pairs`` is where the first comes before the second."""

    i: int
    j: int
    a: Group
    b: Group
    pairs: np.ndarray
    cosine: np.ndarray


def _packed(batches):
    """The variants of a batch and block as one row: their terms by number, the words once."""
    for batch in batches:
        block, doc_id, doc_seq, lists = batch.columns
        for k in pc.unique(block).to_pylist():
            own = pc.equal(block, k)
            ids, seq, part = (x.filter(own) for x in (doc_id, doc_seq, lists))
            size = pc.fill_null(pc.list_value_length(part), 0)
            term, tf, df = (pc.struct_field(pc.list_flatten(part), c) for c in ("term", "tf", "df"))
            coded = term.dictionary_encode()
            words, at = coded.dictionary, np.zeros(len(coded.dictionary), np.int64)
            at[coded.indices.to_numpy()] = np.arange(len(term))
            tables = [pa.table({"id": ids, "seq": seq, "size": size}), pa.table({"code": coded.indices, "tf": tf}), pa.table({"term": words, "df": df.take(pa.array(at))})]
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *(pa.array([_written(t)], pa.binary()) for t in tables)], ["block", "documents", "entries", "words"])


def _written(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _groups(batches, n_docs: int, order: str) -> tuple[Group, Group] | None:
    """The two blocks of a partition, the same one twice on the diagonal."""
    parts = [r for batch in batches for r in batch.to_pylist()]
    if not parts:
        return None
    tables = [[pa.ipc.open_stream(r[c]).read_all() for c in ("documents", "entries", "words")] for r in parts]
    words = pa.concat_tables([t[2] for t in tables])
    all_words = pc.unique(words["term"])
    sides = {}
    for x in {parts[0]["x"], parts[0]["y"]}:
        own = [t for r, t in zip(parts, tables) if r["block"] == x]
        if not own:
            return None
        documents = pa.concat_tables([t[0] for t in own]).combine_chunks()
        term = np.concatenate([pc.index_in(t[2]["term"], value_set=all_words).to_numpy()[t[1]["code"].to_numpy()] for t in own])
        df = np.concatenate([t[2]["df"].to_numpy()[t[1]["code"].to_numpy()] for t in own])
        weight = (1 + np.log(np.concatenate([t[1]["tf"].to_numpy() for t in own]))) * np.log(1 + n_docs / df)
        rows = pc.sort_indices(documents, sort_keys=[(order, "ascending")]).to_numpy()
        place = np.empty(len(rows), np.int64)
        place[rows] = np.arange(len(rows))
        row = np.repeat(place, documents["size"].to_numpy())
        norm = np.sqrt(np.bincount(row, weight * weight, minlength=len(rows)))
        vectors = ByTerm.of(len(rows), len(all_words), row, term, weight)
        sides[x] = Group(documents["id"].take(pa.array(rows)).combine_chunks(), documents["seq"].to_numpy()[rows], vectors, norm, np.bincount(row, minlength=len(rows)))
    return sides[parts[0]["x"]], sides[parts[0]["y"]]


def _tiles(x: Group, y: Group, size: int = blocks.TILE) -> Iterator[Tile]:
    """Of two blocks all tiles; of one with itself those with a pair in registry order."""
    for i in range(0, len(x.seq), size):
        for j in range(i if x is y else 0, len(y.seq), size):
            a, b = x.part(i, i + size), y.part(j, j + size)
            product = a.norm[:, None] * b.norm
            cosine = blocks.dots(a.vectors, b.vectors)
            np.divide(cosine, product, out=cosine, where=product > 0)
            yield Tile(i, j, a, b, a.seq[:, None] < b.seq, cosine)


def _pairs(tile: Tile) -> Iterator[list]:
    shared = blocks.dots(tile.a.vectors.ones(), tile.b.vectors.ones()).astype(np.float64)
    step = max(1, BATCH // len(tile.b.seq))
    for at in range(0, len(tile.a.seq), step):
        own = slice(at, at + step)
        i, j = np.nonzero(tile.pairs[own])
        common, cosine = shared[own][i, j], tile.cosine[own][i, j]
        i += at
        union = tile.a.terms[i] + tile.b.terms[j] - common
        jaccard = np.divide(common, union, out=np.zeros(len(i)), where=union > 0)
        ends = [pa.array(tile.a.seq[i]), pa.array(tile.b.seq[j]), tile.a.ids.take(pa.array(i)), tile.b.ids.take(pa.array(j))]
        yield [*ends, *map(pa.array, (nearest(cosine, 4), nearest(jaccard, 4), nearest(jaccard * 100, 2)))]


def _by_pair(x: Group, y: Group):
    for tile in _tiles(x, y):
        yield from _pairs(tile)


def _sums(x: Group, y: Group):
    """Of each tile the numbers for the summary; the first pair with the greatest and with the least rounded cosine."""
    for tile in _tiles(x, y):
        if n := int(np.count_nonzero(tile.pairs)):
            exact = tile.cosine[tile.pairs]
            r = nearest(tile.cosine, 4)
            found = []
            for at in (np.argmax(np.where(tile.pairs, r, -1.0)), np.argmin(np.where(tile.pairs, r, np.inf))):
                i, j = divmod(int(at), len(tile.b.seq))
                found += [r[i, j], tile.a.seq[i], tile.b.seq[j], tile.a.ids[i].as_py(), tile.b.ids[j].as_py()]
            yield [pa.array([v]) for v in (n, exact.sum(), exact.min(), exact.max(), *found)]


def _heats(x: Group, y: Group):
    """How many pairs of each heat each variant has here."""
    seen = {id(g): np.zeros((len(HEATS), len(g.seq)), np.int64) for g in (x, y)}
    for tile in _tiles(x, y):
        r = nearest(tile.cosine, 4)
        for k, own in enumerate((r > HIGH, (r > MID) & (r <= HIGH), r <= MID)):
            own &= tile.pairs
            seen[id(x)][k, tile.i : tile.i + len(tile.a.seq)] += own.sum(axis=1)
            seen[id(y)][k, tile.j : tile.j + len(tile.b.seq)] += own.sum(axis=0)
    for g in (x,) if x is y else (x, y):
        for k, name in enumerate(HEATS):
            own = np.flatnonzero(seen[id(g)][k])
            yield [g.ids.take(pa.array(own)), pa.array([name] * len(own), pa.string()), pa.array(seen[id(g)][k][own])]


def _best(k: int):
    def run(x: Group, y: Group):
        """Of each variant of either block the k most like it in the other."""
        for own, others in ((x, y),) if x is y else ((x, y), (y, x)):
            for i in range(0, len(own.seq), blocks.TILE):
                held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
                a = own.part(i, i + blocks.TILE)
                for j in range(0, len(others.seq), blocks.TILE):
                    b = others.part(j, j + blocks.TILE)
                    score = blocks.dots(a.vectors, b.vectors)
                    product = a.norm[:, None] * b.norm
                    np.divide(score, product, out=score, where=product > 0)
                    score = nearest(score, 6)
                    if own is others and i == j:
                        np.fill_diagonal(score, 0.0)
                    p, q = blocks.best(score, k)
                    held = tuple(np.concatenate(v) for v in zip(held, (p, q + j, score[p, q])))
                    order = np.lexsort((held[1], -held[2], held[0]))  # the columns are in the order of doc_id
                    query = held[0][order]
                    keep = order[np.arange(len(order)) - np.searchsorted(query, query) < k]
                    held = tuple(v[keep] for v in held)
                yield [a.ids.take(pa.array(held[0])), others.ids.take(pa.array(held[1])), pa.array(held[2])]

    return run


def _of_pairs(index: Index, tale_type: str, what, schema: str, order: str = "seq") -> DataFrame:
    """Rows that ``what`` makes of every two blocks of the variants.

    The variants are cut into blocks by registry order, and each two blocks meet in one task, as packed vectors: no pair, and no product of two
    postings, is shuffled.  A variant is sent once for each block, and the tasks hold two blocks and one tile of scores.
    """
    ship(index.registry.sparkSession)
    plain_unions(index.registry.sparkSession)
    docs = variants(index, tale_type).select("doc_id", F.col("doc_seq").cast("bigint").alias("doc_seq"), "token_count").where("doc_seq IS NOT NULL")
    n = docs.count()
    count = max(1, min(SHARES, n // LEAST), -(-n // BLOCK))
    bounds = sorted({*docs.agg(F.percentile_approx("doc_seq", [k / count for k in range(1, count)], 100_000)).first()[0]}) if count > 1 else []
    block = F.lit(0)
    for b in bounds:
        block = block + (F.col("doc_seq") > F.lit(b)).cast("int")
    ids = docs.select("doc_id", "doc_seq", block.alias("block"))
    lists = index.documents.select("doc_id", F.transform("terms", lambda t: F.struct(t["term"].alias("term"), t["tf"].alias("tf"), t["df"].alias("df"))).alias("terms"))
    some = lists.join(F.broadcast(ids) if n <= BROADCAST_ROWS else ids, "doc_id").select("block", "doc_id", "doc_seq", "terms")
    none = docs.where("token_count = 0").select(block.alias("block"), "doc_id", "doc_seq", F.array().cast(lists.schema["terms"].dataType).alias("terms"))
    rows = some.unionByName(none)
    packed = rows.mapInArrow(_packed, "block int, documents binary, entries binary, words binary")
    every, own = F.sequence(F.lit(0), F.lit(len(bounds))), F.col("block")
    pair = F.transform(every, lambda o: F.struct(F.least(own, o).alias("x"), F.greatest(own, o).alias("y")))
    tasks = (len(bounds) + 1) * (len(bounds) + 2) // 2
    sent = packed.select("*", F.inline(pair)).withColumn("task", (F.col("y") * (F.col("y") + 1) / 2 + F.col("x")).cast("int"))
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(batches, n_docs=index.n_docs):
        if found := _groups(batches, n_docs, order):
            for arrays in what(*found):
                yield pa.RecordBatch.from_arrays(arrays, names)

    return sent.repartitionById(tasks, "task").mapInArrow(run, schema)


def matrix(index: Index, tale_type: str) -> DataFrame:
    """Every two variants in registry order: cosine and jaccard to 4 places, vocabulary overlap in per cent to 2; pairs without a shared term have 0.

    A report on one type, whose result is those pairs.
    """
    return _of_pairs(index, tale_type, _by_pair, "seq_a bigint, seq_b bigint, doc_a string, doc_b string, cosine double, jaccard double, overlap double")


def nearest_variants(index: Index, tale_type: str, k: int = 5) -> DataFrame:
    """(doc_id, other, cosine, place): of each variant the ``k`` others most like it (ties by doc_id); those without a common term are left out.

    No pairs are made: every two blocks of variants give the best of each variant.
    """
    best = _of_pairs(index, tale_type, _best(k), "doc_id string, other string, cosine double", "id")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("cosine"), "other"))
    return best.withColumn("place", place).where(F.col("place") <= k)


def summary(index: Index, tale_type: str) -> DataFrame:
    """One row: mean, least and greatest cosine, and the first pair with the greatest and the least rounded one; no pairs are made."""
    ends = [f"{p}_{c}" for p in ("similar", "divergent") for c in ("r double", "seq_a bigint", "seq_b bigint", "a string", "b string")]
    rows = _of_pairs(index, tale_type, _sums, f"pairs bigint, total double, least double, greatest double, {', '.join(ends)}")
    most = F.struct("similar_r", -F.col("similar_seq_a"), -F.col("similar_seq_b"))
    fewest = F.struct("divergent_r", "divergent_seq_a", "divergent_seq_b")
    pairs = F.coalesce(F.sum("pairs"), F.lit(0))
    of = lambda x: F.round(F.coalesce(x, F.lit(0.0)), 4)
    return rows.agg(
        pairs.alias("pairs"), of(F.sum("total") / F.when(pairs > 0, pairs)).alias("mean"), of(F.min("least")).alias("least"), of(F.max("greatest")).alias("greatest"),
        *(F.max_by(f"similar_{c}", most).alias(f"similar_{c}") for c in "ab"), *(F.min_by(f"divergent_{c}", fewest).alias(f"divergent_{c}") for c in "ab"),
    )


def heat_counts(index: Index, tale_type: str) -> DataFrame:
    """(doc_a, heat, pairs): how many others are so near to each variant, by the rounded cosine; no pairs are made."""
    rows = _of_pairs(index, tale_type, _heats, "doc_a string, heat string, n bigint")
    return rows.groupBy("doc_a", "heat").agg(F.sum("n").alias("pairs"))


def centroid_terms(index: Index, tale_type: str, k: int = 20) -> DataFrame:
    """The ``k`` terms of greatest mean weight over the variants (absent is 0); ties by term."""
    docs = variants(index, tale_type).select("doc_id")
    n = docs.count()
    rows = terms_of(index.documents.join(docs, "doc_id")).groupBy("term").agg((F.sum(plain(index.n_docs)) / F.lit(float(max(1, n)))).alias("exact"))
    return rows.select("term", F.round("exact", 6).alias("weight")).orderBy(F.desc("weight"), "term").limit(k)


def divergence(index: Index, tale_type: str) -> Divergence | None:
    """All four tables for one tale type; None if it has no variant."""
    docs = variants(index, tale_type)
    if docs.isEmpty():
        return None
    return Divergence(docs, matrix(index, tale_type), centroid_terms(index, tale_type), summary(index, tale_type))


def symmetric(matrix: DataFrame) -> DataFrame:
    """Every pair in both directions, with a bucket for its heat."""
    swapped = matrix.select(F.col("seq_b").alias("seq_a"), F.col("seq_a").alias("seq_b"), F.col("doc_b").alias("doc_a"), F.col("doc_a").alias("doc_b"), "cosine", "jaccard", "overlap")
    return matrix.unionByName(swapped).withColumn("heat", heat(F.col("cosine")))


HEATS, HIGH, MID = ("high", "mid", "low"), 0.5, 0.25


def heat(cosine: Column) -> Column:
    return F.when(cosine > HIGH, HEATS[0]).when(cosine > MID, HEATS[1]).otherwise(HEATS[2])
