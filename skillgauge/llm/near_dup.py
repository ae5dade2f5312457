"""MinHash near-dedup with tensored banding (operator 4).

A document is the set of its shingles of n words. Two collections of m short minhash keys, of r values
each, are computed; a table is a pair of one key from either collection, so 2·m keys make m² tables
and only 2·m·r minhashes are needed instead of m²·2·r. Documents that agree in some table are
candidates. A pair of similarity s meets in some table with probability (1 − (1 − s^r)^m)²: 0.9998 at
0.8 and more above. Candidates are verified on their full sets.

Equal sets are one node, so exact copies cost one row each and nothing more. Large tables are not
paired out: every member is first verified against one member of its table; verified links join
components, and only members of one table in different components are compared further, first against
the member that shares most of its set, then with each other. Before that bounds thin out the members exactly: shingles
that no open member of another component has cannot be shared with one, so a member whose other
shingles are too few for any link is closed, which in turn takes shingles from the rest. In the last
step two members are a pair if they share one of the rarest shingles that a link has to contain, or,
for a link that rests on common shingles alone, if both have enough of those and share a table. So no
candidate pair that could still join two components is left out, and a group of edited copies does not
turn into all its pairs.

Sets are compared by the 64-bit hashes of their shingles.

Defined results: ids are integers, rows with one id are one document and share its component; null and
wordless texts have empty sets and no links; texts with fewer words than a shingle are one shingle;
null ids form a document of their own; an empty table gives an empty table; only the id and the text
are read by the report.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from skillgauge.llm import blocks
from skillgauge.llm.components import connected_components
from skillgauge.llm.storage import broadcast_if_small, stored
from skillgauge.llm.tokens import Words, salted, sequences, slices, windows

SIMILARITY = 80
#: Words of a shingle where no contract says otherwise.
SHINGLE_WORDS = 5
KEYS = 9
VALUES_PER_KEY = 2
_NULL_ID = -(2**63)
#: Rows of tables that a task makes, about.
_TABLE_ROWS = 2_000_000
#: Shingles in more open members than this are common.
_RARE = 32


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = Words(texts, lower=True)
    hashes, _, owners = windows(words, n)
    cuts = np.searchsorted(owners, np.arange(len(texts) + 1))
    sets = []
    for k, count in enumerate(words.counts().tolist()):
        if count >= n or not count:
            sets.append(np.unique(hashes[cuts[k] : cuts[k + 1]]))
        else:
            sets.append(sequences(words.hashes[words.first[k] : words.first[k + 1]], count))
    return sets


def _minhashes(sets: list[np.ndarray], n_hashes: int) -> np.ndarray:
    """Smallest salted hash of every non-empty set, by set and salt."""
    every = np.concatenate(sets)
    first = np.concatenate([[0], np.cumsum([len(s) for s in sets])])[:-1]
    return np.stack([np.minimum.reduceat(salted(every, 1000 + k), first) for k in range(n_hashes)], 1)


def signatures(docs: DataFrame, shingle: int, keys: int = KEYS, values: int = VALUES_PER_KEY, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, two digests of the set, and the keys of either collection."""
    narrow = docs.select(
        F.coalesce(F.col(f"`{id_column}`").cast("long"), F.lit(_NULL_ID)).alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")
    )
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64())]
        + [("left", pa.list_(pa.int64())), ("right", pa.list_(pa.int64()))]
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield signed(part)

    def signed(part: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(part.column("text"), shingle)
        sizes = np.array([len(s) for s in sets], np.int64)
        full = np.flatnonzero(sizes)
        digests = np.zeros((len(sets), 2), np.int64)
        sides: list[list] = [[None] * len(sets), [None] * len(sets)]
        if len(full):
            filled = [sets[k] for k in full]
            with np.errstate(over="ignore"):
                for at in range(2):
                    digests[full, at] = [np.add.reduce(salted(s, 500 + at)).view(np.int64) for s in filled]
                low = _minhashes(filled, 2 * keys * values).reshape(len(full), 2, keys, values)
            joined = sequences(low.reshape(-1), values)[::values].reshape(len(full), 2, keys).view(np.int64)
            for row, k in enumerate(full.tolist()):
                sides[0][k], sides[1][k] = joined[row, 0], joined[row, 1]
        columns = [part.column("doc_id"), sizes, digests[:, 0], digests[:, 1], *sides]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return narrow.mapInArrow(
        scan, "doc_id bigint, n_shingles bigint, d1 bigint, d2 bigint, left array<bigint>, right array<bigint>"
    )


def _table_rows(nodes: DataFrame) -> DataFrame:
    """A row per node and table: the pair of one key of either collection."""
    pairs = F.transform("left", lambda x, i: F.transform("right", lambda y, j: F.xxhash64(x, y, i, j)))
    return nodes.select("node", "n_shingles", F.explode_outer(F.flatten(pairs)).alias("key"))


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = np.zeros(batch.num_rows, bool)
            at = 0
            for part in slices(batch, "text_b"):
                ones, others = shingle_sets(part.column("text_a"), shingle), shingle_sets(part.column("text_b"), shingle)
                for one, other in zip(ones, others):
                    small, large = sorted((len(one), len(other)))
                    if small and 100 * small >= similarity * large:
                        both = len(np.intersect1d(one, other, assume_unique=True))
                        kept[at] = 100 * both >= similarity * (small + large - both)
                    at += 1
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(kept)), batch.column(1).filter(pa.array(kept))], names=["a", "b"])

    return joined.mapInArrow(scan, "a bigint, b bigint")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()


def near_duplicates(
    docs: DataFrame,
    shingle: int = SHINGLE_WORDS,
    similarity: int = SIMILARITY,
    keys: int = KEYS,
    values: int = VALUES_PER_KEY,
    id_column: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """doc_id, n_shingles, component_id, one row per document."""
    signed = stored(signatures(docs, shingle, keys, values, id_column, text), "signatures")
    filled = signed.filter("n_shingles > 0")
    # One node per distinct set, named by its smallest id.
    owners = filled.groupBy("d1", "d2").agg(F.min("doc_id").alias("node"))
    placed = stored(filled.select("doc_id", "d1", "d2").join(owners, ["d1", "d2"]).select("doc_id", "d1", "node"), "placed")
    first = filled.join(placed.filter("doc_id = node").select("doc_id", "d1", "node").distinct(), ["doc_id", "d1"])
    nodes = first.select("node", "n_shingles", "left", "right", "d1").dropDuplicates(["node", "d1"])

    # Spread before the tables multiply the rows, so that no task makes more than its share.
    usual = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_tasks = max(usual, -(-owners.count() * keys * keys // _TABLE_ROWS))
    rows = _table_rows(nodes.repartition(n_tasks, "node"))
    shared = rows.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high")
    members = stored(rows.join(shared, "key").select("key", "node", "n_shingles", "low"), "members")
    needed = stored(members.select("node").distinct(), "nodes")
    texts = _texts_of(docs, needed, id_column, text)

    # Rows with one id are one document: their sets are linked without a look at the tables.
    same_id = placed.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a < b")
    every = placed.join(same_id.select("doc_id", "a"), "doc_id").select("a", F.col("node").alias("b")).filter("a < b").distinct()
    links = stored(every, "links")

    # Sizes of a node: one, unless rows of one id have several texts.
    sizes = members.groupBy(F.col("node").alias("a")).agg(F.min("n_shingles").alias("least_a"), F.max("n_shingles").alias("most_a"))
    stars = members.filter("node > low").select(F.col("low").alias("a"), F.col("node").alias("b"), F.col("n_shingles").alias("n_b")).distinct()
    near = 100 * F.least("most_a", "n_b") >= similarity * F.greatest("least_a", "n_b")
    pairs = stored(_ordered(stars.join(sizes, "a").filter(near)), "pairs")
    checked = pairs
    links = stored(links.unionByName(_verified(pairs, texts, shingle, similarity)), "links")
    components = stored(connected_components(links), "components")
    left = None
    for last in (False, True):
        left = _bounded(_open_members(members, components), texts, shingle, similarity) if left is None else left
        wanted = _all_pairs(left, texts, shingle, similarity) if last else _pairs_of(_centres(left), left, similarity)
        pairs = stored(wanted.join(checked, ["a", "b"], "left_anti"), "pairs")
        verified = stored(_verified(pairs, texts, shingle, similarity), "verified")
        if verified.isEmpty():
            continue
        checked = stored(checked.unionByName(pairs), "checked")
        links = stored(links.unionByName(verified), "links")
        components = stored(connected_components(links), "components")
        left = None

    named = placed.join(components.withColumnRenamed("component", "root"), "node", "left")
    roots = named.groupBy("doc_id").agg(F.min(F.coalesce("root", "node")).alias("component"))
    result = signed.join(roots, "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    shown = lambda column: F.when(column != _NULL_ID, column)
    return result.select(shown(F.col("doc_id")).alias("doc_id"), "n_shingles", shown(component).alias("component_id"), F.col("d1").alias("digest"))


def _texts_of(docs: DataFrame, needed: DataFrame, id_column: str, text: str) -> DataFrame:
    """node, text: one text of each needed node."""
    narrow = docs.select(F.coalesce(F.col(f"`{id_column}`").cast("long"), F.lit(_NULL_ID)).alias("node"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    wanted = narrow.join(broadcast_if_small(needed, 16), "node", "left_semi")
    return stored(wanted, "texts")


def _open_members(members: DataFrame, components: DataFrame) -> DataFrame:
    """key, node, n_shingles, component of the tables whose members are in several components."""
    labelled = members.join(components, "node", "left").select("key", "node", "n_shingles", F.coalesce("component", "node").alias("component"))
    return stored(_split_tables(labelled), "open")


def _split_tables(labelled: DataFrame) -> DataFrame:
    split = labelled.groupBy("key").agg(F.min("component").alias("one"), F.max("component").alias("other")).filter("one < other")
    return labelled.join(split.select("key"), "key", "left_semi")


def _bounded(left: DataFrame, texts: DataFrame, shingle: int, similarity: int) -> DataFrame:
    """`left` with `foreign`, without members that cannot have a link to another component."""
    counted = _foreign_shingles(left.select("node", "component").distinct(), texts, shingle, similarity)
    able = left.join(counted, "node").filter(100 * F.col("foreign") >= similarity * F.col("n_shingles"))
    return stored(_split_tables(able), "open")


def _pairs_of(one: DataFrame, other: DataFrame, similarity: int, on: str = "key") -> DataFrame:
    """Pairs of different components that agree in `on`, if sizes and foreign shingles allow a link."""
    left, right = (
        side.select(on, *[F.col(c).alias(f"{c}_{name}") for c in ("node", "n_shingles", "component")], F.col("foreign").alias(f"shared_{name}"))
        for side, name in ((one, "a"), (other, "b"))
    )
    most = F.least("shared_a", "shared_b")
    near = 100 * most >= similarity * (F.col("n_shingles_a") + F.col("n_shingles_b") - most)
    apart = F.col("component_a") != F.col("component_b")
    return _ordered(left.join(right, on).filter(apart & near).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")))


def _centres(open_members: DataFrame) -> DataFrame:
    """One member of each table: the one that shares the largest part of its set, the heart of a group of edited copies."""
    row = F.struct((F.col("foreign") / F.col("n_shingles")).alias("part"), "n_shingles", "node", "component", "foreign")
    best = open_members.groupBy("key").agg(F.max(row).alias("c"))
    return best.select("key", "c.node", "c.n_shingles", "c.component", "c.foreign")


def _all_pairs(left: DataFrame, texts: DataFrame, shingle: int, similarity: int) -> DataFrame:
    """Every pair that is still possible once few more members can be closed.

    A link holds similarity percent of the larger set, so it contains one of the rarest shingles of
    either set, as many as the rest leaves. If that one is rare, it is in both `prefix` lists; if all
    such are common, both sets have that many common ones, and the link rests on these alone.
    """
    before = left.count()
    while True:
        left = _bounded(left.select("key", "node", "n_shingles", "component"), texts, shingle, similarity)
        after = left.count()
        if 10 * after >= 9 * before:
            break
        before = after
    nodes = left.drop("key").distinct()
    by_shingle = nodes.select("node", "n_shingles", "component", "foreign", F.explode_outer("prefix").alias("shingle"))
    by_shingle = stored(by_shingle.filter(F.col("shingle").isNotNull()), "prefixes")
    rare = _pairs_of(by_shingle, by_shingle, similarity, "shingle")
    rich = stored(left.filter(100 * F.col("core") >= similarity * F.col("n_shingles")).drop("prefix"), "rich")
    return rare.unionByName(_common_pairs(rich, similarity)).distinct()


def _common_pairs(rich: DataFrame, similarity: int) -> DataFrame:
    """Pairs whose common shingles allow a link, each formed in the first table that both are in.

    One side is never in the table's largest component, and it meets whole groups of members of one
    component and size first, so that only groups which allow a link are taken apart.
    """
    tables = rich.groupBy("node", "n_shingles").agg(F.collect_set("key").alias("keys"))
    rich = stored(rich.join(tables, ["node", "n_shingles"]), "rich")
    groups = rich.groupBy("key", "component", "n_shingles").agg(F.max("core").alias("core"), F.count("*").alias("n"))
    largest = groups.groupBy("key", "component").agg(F.sum("n").alias("n")).groupBy("key").agg(F.max(F.struct("n", "component")).alias("largest"))
    smaller = rich.join(largest, "key").filter(F.col("component") != F.col("largest.component")).drop("largest")

    def near(core: str) -> Column:
        most = F.least("core", core)
        return 100 * most >= similarity * (F.col("n_shingles") + F.col("n_b") - most)

    other = groups.select("key", F.col("component").alias("component_b"), F.col("n_shingles").alias("n_b"), F.col("core").alias("most_b"))
    met = smaller.join(other, "key").filter((F.col("component") != F.col("component_b")) & near("most_b"))
    rows = rich.select(
        "key", F.col("component").alias("component_b"), F.col("n_shingles").alias("n_b"), F.col("core").alias("core_b"), F.col("node").alias("b"), F.col("keys").alias("keys_b")
    )
    first = F.array_min(F.array_intersect("keys", "keys_b")) == F.col("key")
    pairs = met.join(rows, ["key", "component_b", "n_b"]).filter(near("core_b") & first)
    return _ordered(pairs.select(F.col("node").alias("a"), "b"))


_ASK = "shard int, block int, payload binary"
_ANSWER = "block int, shard int, payload binary"


def _foreign_shingles(nodes: DataFrame, texts: DataFrame, shingle: int, similarity: int) -> DataFrame:
    """node; foreign: how many of its shingles a given node of another component has, too; core: how
    many of those are common; prefix: the rarest of the others that a link may have to contain.

    Blocks of nodes ask shards of shingles for the smallest and largest component of each shingle, and
    how many nodes have it.
    """
    placed = texts.join(nodes, "node")
    _, n_blocks = blocks.plan_blocks(placed, "text")
    dealt = blocks.in_blocks(placed, n_blocks, "node", "text", F.col("component"))
    bounds = blocks.shard_bounds(n_blocks)

    def spans(table: pa.Table) -> tuple[np.ndarray, ...]:
        """Sorted distinct shingles of a block with their smallest and largest component and number of nodes."""
        sets = [s for part in slices(table, "text") for s in shingle_sets(part.column("text").combine_chunks(), shingle)]
        every = np.concatenate([np.empty(0, np.uint64), *sets])
        owner = np.repeat(table.column("component").to_numpy(), [len(s) for s in sets])
        order = np.argsort(every)
        every, owner = every[order], owner[order]
        first = np.flatnonzero(np.diff(every, prepend=~every[:1]) != 0)
        if not len(first):
            return every, owner, owner, owner
        return every[first], np.minimum.reduceat(owner, first), np.maximum.reduceat(owner, first), np.diff(first, append=len(every))

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        hashes, *facts = spans(table)
        block = key[0].as_py()
        rows = [
            (number, block, blocks.joined(blocks.pack_sorted(hashes[a:b]), *[blocks.pack(fact[a:b].astype(np.int64).view(np.uint64)) for fact in facts]))
            for number, a, b in blocks.by_shard(hashes, bounds)
        ]
        return _table(rows, ["shard", "block", "payload"])

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        parts = [blocks.parted(payload.as_py(), 4) for payload in table.column("payload")]
        keys = [blocks.unpack_sorted(part[0]) for part in parts]
        every = np.concatenate(keys)
        low, high, n = (np.concatenate([blocks.unpack(part[k]).view(np.int64) for part in parts]) for k in (1, 2, 3))
        order = np.argsort(every)
        first = np.flatnonzero(np.diff(every[order], prepend=~every[order[:1]]) != 0)
        distinct = every[order][first]
        several = np.minimum.reduceat(low[order], first) < np.maximum.reduceat(high[order], first)
        often = np.minimum(np.add.reduceat(n[order], first), _RARE + 1)
        shard, rows = key[0].as_py(), []
        for block, own in zip(table.column("block").to_pylist(), keys):
            at = np.searchsorted(distinct, own)
            kept = several[at]
            rows.append((block, shard, blocks.joined(blocks.pack_sorted(own[kept]), blocks.pack(often[at[kept]]))))
        return _table(rows, ["block", "shard", "payload"])

    def count(table: pa.Table, replies: pa.Table) -> pa.Table:
        parts = [blocks.parted(payload.as_py(), 2) for payload in replies.column("payload")]
        shared = np.concatenate([np.empty(0, np.uint64), *[blocks.unpack_sorted(part[0]) for part in parts]])
        often = np.concatenate([np.empty(0, np.uint64), *[blocks.unpack(part[1]) for part in parts]])
        order = np.argsort(shared)
        shared, often = shared[order], often[order]
        foreign, core, prefix = [], [], []
        for part in slices(table, "text"):
            for s in shingle_sets(part.column("text").combine_chunks(), shingle):
                known = s[blocks.contained(s, shared)]
                times = often[np.searchsorted(shared, known)]
                rare = np.flatnonzero(times <= _RARE)
                # Rarest first, shingles that nobody shares before all others.
                wanted = len(s) - (-(-similarity * len(s) // 100)) + 1 - (len(s) - len(known))
                rare = rare[np.lexsort((known[rare], times[rare]))][: max(wanted, 0)]
                foreign.append(len(known))
                core.append(int((times > _RARE).sum()))
                prefix.append(known[rare].view(np.int64))
        columns = {"node": table.column("doc_id"), "foreign": pa.array(foreign, pa.int64()), "core": pa.array(core, pa.int64())}
        return pa.table(columns | {"prefix": pa.array(prefix, pa.list_(pa.int64()))})

    asked = dealt.groupBy("block").applyInArrow(ask, _ASK)
    answered = asked.groupBy("shard").applyInArrow(answer, _ANSWER)
    counted = dealt.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(
        count, "node bigint, foreign bigint, core bigint, prefix array<bigint>"
    )
    # Rows of one id may have several texts; the largest counts and all their shingles are the safe ones.
    return counted.groupBy("node").agg(F.max("foreign").alias("foreign"), F.max("core").alias("core"), F.flatten(F.collect_list("prefix")).alias("prefix"))


def _table(rows: list[tuple], names: list[str]) -> pa.Table:
    kinds = [pa.binary() if name == "payload" else pa.int32() for name in names]
    return pa.table({name: pa.array([row[k] for row in rows], kind) for k, (name, kind) in enumerate(zip(names, kinds))})


def duplicate_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    found = near_duplicates(docs, **options)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one_each(docs: DataFrame, id_column: str = "doc_id", **options) -> DataFrame:
    """The documents with the smallest id of their component, with their own columns."""
    found = near_duplicates(docs, id_column=id_column, **options)
    gone = stored(found.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    gone = broadcast_if_small(gone, 16)
    return docs.join(gone, docs[id_column].cast("long").eqNullSafe(gone["__gone"]), "left_anti")
