"""Near-duplicate classes: banded MinHash candidates, sequential Bayesian pruning, exact linking.

Rows with the same shingle set are one class from the start, so a group of equal
texts costs one signature however large it is.  Classes that share a band are
compared with up to three hubs of that band (its smallest, its largest and a
hash-chosen member): rows grow with the members, not with their pairs.  Signatures
are compared batch by batch; a pair is given up as soon as the posterior
probability that its similarity reaches the threshold falls below the chosen miss
probability.  The pairs that stay join classes into loose groups; in bands that still
hold several loose groups, the members outside the band's largest group are compared
with all of its members, signatures only.  After that every surviving candidate pair
lies inside one loose group.

Links are exact, on full shingle sets.  Each member is first compared with its
likeliest partner, so that a group of near copies costs about one text for each
member; only members that this leaves outside the largest linked part of their loose
group are then compared with the rest of the group.  Both steps work in cells that
are bounded by shingles, not by rows.  Where a group falls into many parts that are
alike but not linked, the copies of its texts still grow with (members x members
outside the largest part) / CELL.  The only candidates that are not looked at are
those that share no band: (1 - t^rows)^bands, 7e-8 for a pair just at t = 0.85 with
the defaults.

Nulls and edges: a null text is empty; a text without words has no set and links
with nothing; a row whose id is null links with nothing, keeps a null component and
is kept.  Rows that share an id are one document: its component is that of all texts
under the id, an empty one included.  Texts of any length are read whole, one at a
time if need be; repeated rows give repeated results; an empty table gives an empty
result; columns other than the named ones are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grafonda.llm import textkit as T
from grafonda.llm.common import in_arrow, read, require
from grafonda.operators.components import star_components
from grafonda.plans.skew import meet
from grafonda.plans.scratch import cut, drop

#: Most members, and most shingles, that one block of a group holds; two blocks meet in one cell, the most that a task holds at a time.
BLOCK, CELL = 1024, 1 << 18
#: What a set counts in CELL besides its shingles.
SET_WEIGHT = 256


def least_matches(n: int, t: float, miss: float) -> int:
    """Fewest matches of n for which similarity >= t keeps a posterior probability of `miss` (uniform prior)."""
    total = 0.0
    for m in range(n + 1):
        total += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if total >= miss:
            return m
    return n


class Posterior:
    """Batch sizes and the fewest matches to go on with after each of them."""

    def __init__(self, size: int, t: float, miss: float, batch: int) -> None:
        self.steps = [(a, min(a + batch, size)) for a in range(0, size, batch)]
        self.least = [least_matches(b, t, miss) for _, b in self.steps]

    def survivors(self, left: np.ndarray, right: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the pairs (left[a[i]], right[b[i]]) that no batch rules out, and their equal slots."""
        alive, got = np.arange(len(a)), np.zeros(len(a), np.int32)
        for (lo, hi), least in zip(self.steps, self.least, strict=True):
            if not len(alive):
                break
            got = got + (left[a[alive], lo:hi] == right[b[alive], lo:hi]).sum(1)
            go = got >= least
            alive, got = alive[go], got[go]
        return alive, got


def _signatures(column: pa.Array, size: int) -> np.ndarray:
    data = np.frombuffer(b"".join(column.to_pylist()), np.uint16) if len(column) else np.zeros(0, np.uint16)
    return data.reshape(-1, size)


def sketch(docs: DataFrame, id_col: str, text_col: str, words: int, size: int) -> DataFrame:
    """(id, n, d1, d2, sig): set size, 128-bit digest of the set and MinHash signature (16 bits a slot)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, salt = T.MinHash(size), T.stream(23, 1)[0]
        for whole in batches:
            for part in T.slices(whole, "text"):
                values, first = T.shingle_sets(part.column("text"), words)
                with np.errstate(over="ignore"):
                    d1 = T.segment(np.add, T.mix(values), first)
                    d2 = T.segment(np.add, T.mix(values ^ salt), first)
                sig = (hasher.sign(values, first) >> 16).astype(np.uint16)
                n = np.diff(first)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"),
                        pa.array(n, pa.int64()),
                        pa.array(d1.view(np.int64)),
                        pa.array(d2.view(np.int64)),
                        pa.array([row.tobytes() if k else None for row, k in zip(sig, n.tolist(), strict=True)], pa.binary()),
                    ],
                    names=["id", "n", "d1", "d2", "sig"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return in_arrow(rows, run, "id long, n long, d1 long, d2 long, sig binary")


def band_rows(classes: DataFrame, bands: int, rows: int, size: int) -> DataFrame:
    """(key, id): one row for each class and band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = T.band_keys(_signatures(batch.column("sig"), size), bands, rows)
            ids = np.repeat(np.asarray(batch.column("id")), bands)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(ids)], names=["key", "id"])

    return in_arrow(classes.select("id", "sig"), run, "key long, id long")


def _likely(pairs: DataFrame, classes: DataFrame, post: Posterior, size: int) -> DataFrame:
    """The pairs (a, b) that the sequential test leaves, with their equal slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = _signatures(batch.column("sa"), size), _signatures(batch.column("sb"), size)
            at = np.arange(batch.num_rows)
            alive, equal = post.survivors(x, y, at, at)
            keep = pa.array(alive)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep), pa.array(equal, pa.int32())], names=["a", "b", "equal"])

    sig = classes.select("id", "sig")
    both = pairs.join(sig.toDF("a", "sa"), "a").join(sig.toDF("b", "sb"), "b")
    return in_arrow(both.select("a", "b", "sa", "sb"), run, "a long, b long, equal int")


def in_cells(rows: DataFrame, group: str, label: str, weight: Column, most: int) -> DataFrame | None:
    """Send the rows of a group to cells in which each pair of different labels meets, one of them a visitor.

    The visitors are the rows that do not carry the group's weightiest label; a pair
    of which neither end is a visitor has one label and need not meet.  Residents
    (all rows) and visitors are dealt to blocks of about `most` weight; cell (i, j)
    holds block i of the residents and block j of the visitors.  A group of one label
    has no cells; one with few visitors has about one copy of each row.  Adds `cell`
    and `visitor`; None if all groups are of one label.
    """
    weighed = rows.withColumn("w", weight)
    by_label = weighed.groupBy(group, label).agg(F.sum("w").alias("w"))
    tops = by_label.groupBy(group).agg(F.sum("w").alias("all_w"), F.max(F.struct("w", label)).alias("top"), F.count(F.lit(1)).alias("labels"))
    blocks = [F.ceil(w / F.lit(most)).cast("int").alias(name) for w, name in ((F.col("all_w"), "homes"), (F.col("all_w") - F.col("top.w"), "guests"))]
    mixed = cut(tops.where("labels > 1").select(group, F.col(f"top.{label}").alias("top"), *blocks))
    if not mixed.take(1):
        drop(mixed)
        return None
    placed = rows.join(mixed, group)  # a written table: the join has shuffles of its own, or none
    home, guest = F.pmod(F.xxhash64("id", F.lit(1)), F.col("homes")), F.pmod(F.xxhash64("id", F.lit(2)), F.col("guests"))

    def spot(i: Column, j: Column, visitor: bool) -> Column:
        return F.struct(F.xxhash64(F.col(group), i.cast("int"), j.cast("int")).alias("cell"), F.lit(visitor).alias("visitor"))

    stays = F.transform(F.sequence(F.lit(0), F.col("guests") - 1), lambda j: spot(home, j, False))
    calls = F.transform(F.sequence(F.lit(0), F.col("homes") - 1), lambda i: spot(i, guest, True))
    spots = F.when(F.col(label) == F.col("top"), stays).otherwise(F.concat(stays, calls))
    return placed.withColumn("spot", F.explode(spots)).select(*rows.columns, "spot.cell", "spot.visitor")


def _by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of one cell each from batches that are sorted by cell."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cells = np.asarray(batch.column("cell"))
        cuts = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), len(cells)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and cells[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = cells[a]
    if held:
        yield pa.Table.from_batches(held)


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).combine_chunks().to_numpy(zero_copy_only=False)


def _pairs(links: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    if links:
        a, b = zip(*links, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _join_labels(label: np.ndarray, x: int, hits: np.ndarray) -> list[int]:
    """One hit of each label that is not x's own; those labels become x's."""
    new = []
    for y in hits.tolist():
        if label[y] != label[x]:
            new.append(y)
            label[label == label[y]] = label[x]
    return new


def _cross_group(rows: DataFrame, post: Posterior, size: int) -> DataFrame:
    """Likely pairs of visitors and residents of different loose groups, enough of them to join the groups of each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_cell(batches):
            ids, visitor = _column(table, "id"), _column(table, "visitor")
            label = np.unique(_column(table, "loose"), return_inverse=True)[1]
            sig = _signatures(table.column("sig").combine_chunks(), size)
            links = []
            for x in np.flatnonzero(visitor).tolist():
                rest = np.flatnonzero(~visitor & (label != label[x]))
                if len(rest):
                    hit = rest[post.survivors(sig, sig, np.full(len(rest), x), rest)[0]]
                    links += [(int(ids[x]), int(ids[y])) for y in _join_labels(label, x, hit)]
            yield from _pairs(links)

    return in_arrow(rows, run, "a long, b long")


def _spanning(ids: np.ndarray, label: np.ndarray, visitor: np.ndarray, values: np.ndarray, first: np.ndarray, pct: int) -> list[tuple[int, int]]:
    """Exact links between visitors and residents of one cell, enough of them to join all labels that links join.

    Intersection sizes come from an inverted index of the residents' shingles; a
    pair whose labels earlier links have joined is not counted again.
    """
    n, sizes = len(ids), np.diff(first)
    label = np.unique(label, return_inverse=True)[1]
    owner = np.repeat(np.arange(n, dtype=np.int32), sizes)
    at_home = ~visitor[owner]
    order = np.argsort(values[at_home], kind="stable")
    found, posting = values[at_home][order], owner[at_home][order]
    if not len(found):
        return []
    start = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
    stop, found = np.append(start[1:], len(found)), found[start]
    links = []
    for x in np.flatnonzero(visitor & (sizes > 0)).tolist():
        other = ~visitor & (label != label[x]) & (sizes > 0)
        if not other.any():
            continue
        mine = values[first[x] : first[x + 1]]
        at = np.minimum(np.searchsorted(found, mine), len(found) - 1)
        at = at[found[at] == mine]
        lens = stop[at] - start[at]
        spots = np.arange(int(lens.sum())) + np.repeat(start[at] - (np.cumsum(lens) - lens), lens)
        shared = np.bincount(posting[spots], minlength=n)
        hits = np.flatnonzero(other & (100 * shared >= pct * (sizes + sizes[x] - shared)))
        links += [(int(ids[x]), int(ids[y])) for y in _join_labels(label, x, hits)]
    return links


def _exact_links(rows: DataFrame, words: int, pct: int) -> DataFrame:
    """Exact links inside cells, from full texts; a text counts only if it is that of its class (rows may share an id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_cell(batches):
            ids, label, visitor, want = (_column(table, c) for c in ("id", "label", "visitor", "d1"))
            values, sizes = [], []
            for whole in table.select(["text"]).combine_chunks().to_batches():
                for part in T.slices(whole, "text"):
                    v, f = T.shingle_sets(part.column("text"), words)
                    values.append(v)
                    sizes.append(np.diff(f))
            flat, counts = np.concatenate(values), np.concatenate(sizes)
            del values, table
            first = np.concatenate([[0], np.cumsum(counts)])
            with np.errstate(over="ignore"):
                own = T.segment(np.add, T.mix(flat), first).view(np.int64) == want
            if not own.all():
                flat = flat[np.repeat(own, counts)]
                first = np.concatenate([[0], np.cumsum(counts * own)])
            yield from _pairs(_spanning(ids, label, visitor, flat, first, pct))

    return in_arrow(rows, run, "a long, b long")


def _cells(rows: DataFrame) -> DataFrame:
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return rows.repartition(parts, "cell").sortWithinPartitions("cell")


def _with_hubs(members: DataFrame) -> DataFrame:
    """members(id, n, hub) in cells with their hubs, which are the visitors: a hub with many members has a cell for each block of them."""
    weighed = members.withColumn("w", F.col("n") + SET_WEIGHT)
    sizes = weighed.groupBy("hub").agg(F.ceil(F.sum("w") / F.lit(CELL)).cast("int").alias("homes"))
    cell = F.xxhash64("hub", "block")
    placed = meet(weighed, "hub", sizes).withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.col("homes")).cast("int"))
    at_home = placed.select("id", cell.alias("cell"), F.lit(False).alias("visitor"))
    hubs = sizes.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("homes") - 1)))
    return at_home.union(hubs.select(F.col("hub").alias("id"), cell.alias("cell"), F.lit(True)))


def _bands_of(classes: DataFrame, bands: int, rows: int, size: int) -> DataFrame:
    """(key, id, members, hubs) of the bands that two classes or more share; the hubs are the smallest, the largest and a hash-chosen one."""
    keyed = cut(band_rows(classes, bands, rows, size))
    hubs = (
        keyed.groupBy("key")
        .agg(F.count(F.lit(1)).alias("members"), F.min("id").alias("h1"), F.max("id").alias("h2"), F.min(F.struct(F.xxhash64("id"), "id")).alias("h3"))
        .where("members > 1")
        .select("key", "members", F.array("h1", "h2", "h3.id").alias("hubs"))
    )
    shared = cut(meet(keyed, "key", hubs))
    drop(keyed)
    return shared


def near_duplicate_classes(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    pct: int = 80,
    bands: int = 28,
    rows: int = 5,
    batch: int = 20,
    miss: float = 1e-6,
) -> DataFrame:
    """(id, n_shingles, component_id) for every row: the smallest id linked with it, directly or not.

    Two documents are linked if 100 * |A & B| >= pct * |A | B| on their sets of
    distinct `words`-word shingles.  `bands` and `rows` should give
    (1 - (pct/100)^rows)^bands well below the number of links that may be lost.
    """
    size = bands * rows
    post = Posterior(size, pct / 100, miss, batch)
    texts = require(docs, id_col, text_col).toDF("id", "text").withColumn("id", F.col("id").cast("long"))
    rough = cut(sketch(docs, id_col, text_col, words, size))
    known, digest = rough.where("id is not null"), ["d1", "d2", "n"]

    # ids of several rows; if the rows' sets differ, their classes get names of their own and are joined at the end
    sets_of_id = known.groupBy("id").agg(F.min(F.struct(*digest)).alias("lo"), F.max(F.struct(*digest)).alias("hi"), F.count(F.lit(1)).alias("rows"))
    repeated = cut(sets_of_id.where("rows > 1").select("id", (F.col("lo") != F.col("hi")).alias("odd")))
    several = repeated.where("odd")
    classes = known.where("n > 0").groupBy(*digest).agg(F.min("id").alias("low"), F.first("sig").alias("sig"))
    classes = classes.join(several.withColumnRenamed("id", "low"), "low", "left")
    classes = cut(classes.select(*digest, "low", "sig", F.when(F.col("odd"), F.xxhash64(*digest)).otherwise(F.col("low")).alias("id")))

    shared = _bands_of(classes, bands, rows, size)
    star = shared.select("id", F.explode("hubs").alias("hub")).where("id <> hub")
    star = star.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
    near = cut(_likely(star, classes, post, size))
    groups = star_components(near, "a", "b")

    # a band of two or three members had every pair tested against its hubs
    placed = shared.where("members > 3").select("key", "id").join(groups, "id", "left").select("key", "id", F.coalesce("component", "id").alias("loose"))
    spent = [shared, near, groups]
    ends, cells = near, in_cells(placed, "key", "loose", F.lit(1), BLOCK)
    if cells is not None:
        crossing = cut(_cross_group(_cells(cells.join(classes.select("id", "sig"), "id")), post, size))
        groups = star_components(groups.toDF("a", "b").union(crossing), "a", "b")
        ends = ends.union(crossing.withColumn("equal", F.lit(0)))
        spent += [crossing, groups]

    # each member against its likeliest partner, then what that leaves apart inside a loose group
    ends = ends.union(ends.select("b", "a", "equal"))
    best = ends.groupBy(F.col("a").alias("id")).agg(F.max(F.struct("equal", F.bitwise_not("b").alias("flipped"))).alias("best"))
    best = best.select("id", F.bitwise_not("best.flipped").alias("hub"))
    sets = classes.select("id", "low", "d1", "n")
    full = texts.withColumnRenamed("id", "low")
    if repeated.take(1):
        once = texts.join(repeated, "id", "left_anti")
        many = texts.join(repeated, "id", "left_semi").groupBy("id", F.xxhash64("text")).agg(F.first("text").alias("text")).select("id", "text")
        full = once.union(many).withColumnRenamed("id", "low")

    def linked_in(cells: DataFrame) -> DataFrame:
        out = cut(_exact_links(_cells(cells.join(sets.drop("n"), "id").join(full, "low").drop("low")), words, pct))
        spent.append(out)
        return out

    links = linked_in(_with_hubs(best.join(sets.select("id", "n"), "id")).withColumn("label", F.col("id")))
    joined = star_components(links, "a", "b")
    apart = groups.withColumnRenamed("component", "loose").join(sets.select("id", "n"), "id").join(joined, "id", "left")
    apart = apart.select("id", "loose", "n", F.coalesce("component", "id").alias("label"))
    more, cells = [], in_cells(apart, "loose", "label", F.col("n") + SET_WEIGHT, CELL)
    if cells is not None:
        more.append(linked_in(cells.select("id", "cell", "visitor", "label")))
    is_odd = bool(several.take(1))
    if is_odd:
        held = known.join(several.select("id"), "id").where("n > 0").select(F.col("id").alias("doc"), *digest).distinct()
        held = held.join(classes.select(*digest, "id"), digest).select("doc", "id")
        more.append(meet(held, "doc", held.groupBy("doc").agg(F.min("id").alias("first"))).select("first", "id"))
    linked = joined if not more else star_components(reduce(DataFrame.union, more, joined.toDF("a", "b")), "a", "b")

    by_class = classes.select(*digest, "id", "low").join(linked, "id", "left").withColumn("component", F.coalesce("component", "id"))
    lows = by_class.groupBy("component").agg(F.min("low").alias("component_id"))
    by_class = cut(by_class.join(lows, "component").select(*digest, "component_id"))
    mine = rough.select("id", *digest).join(by_class, digest, "left")
    if is_odd:  # an empty row of an id that has a set elsewhere belongs to that document
        of_id = cut(known.join(several.select("id"), "id").where("n > 0").join(by_class, digest).groupBy("id").agg(F.min("component_id").alias("of_id")))
        mine = mine.join(of_id, "id", "left").withColumn("component_id", F.coalesce("component_id", "of_id"))
    for table in (*spent, joined, linked, classes, repeated):
        drop(table)
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return mine.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: classes of near duplicates of `documents`, three-word shingles, similarity 0.85."""
    found = near_duplicate_classes(read(spark, sf_dir, "documents"), words=3, pct=85)
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", kept.alias("kept"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: one document of each group stays, the one with the smallest id; five-word shingles, similarity 0.8.

    Rows that share an id are one document and stay or go together; rows without an id
    or without words stay; other columns pass through; an empty table stays empty.
    """
    gone = near_duplicate_classes(docs, words=5, pct=80, bands=40).where("id <> component_id").select(F.col("id").alias("doc_id"))
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
