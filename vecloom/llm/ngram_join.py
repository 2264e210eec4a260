"""Operator 2, n-gram Jaccard join by grouped prefixes.

A document is the set of its distinct 5-word shingles, as 64-bit hashes. All sets are ordered alike,
rare shingles first: a sketch of fixed size counts shingles over all documents, and the order is by
the sketch's power of two, then the hash. Two sets with Jaccard similarity t or more share one of
their first n - ceil(t * n) + 1 shingles.

1. Equal sets become one class. Classes with the same prefix and size become one group.
2. Groups meet at the shingles of their prefixes. Pairs are filtered by size and by the positions of
   the shared shingle. A shingle of more groups than a cell takes is spread over cells of members
   (block, block), by an exact count of its groups, so no task sees a whole hot list; partners leave
   as one list for each group.
3. Group pairs are laid out in cells of bounded work, the groups' classes are sent there with their
   whole sets, and members are verified exactly. A cell returns a spanning forest of its links;
   members that it has linked already need no test.
4. Alternating stars over all forests give the components.

Defined cases: null, empty or blank text has no shingles, links with nothing and is its own
component; fewer than 5 words are one shingle; rows with a null doc_id take part and never name a
component; repeated rows repeat in the result; other columns are ignored; empty tables are fine.
"""

from __future__ import annotations

from itertools import combinations, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from vecloom.llm.common import drop_stored, maybe_broadcast, released, stored, text_batches, text_bytes
from vecloom.llm.components import components
from vecloom.llm.hashing import gram_hashes, word_hashes

WORDS, PERCENT = 5, 80
SKETCH = 1 << 20
#: Members of one token cell, members of one group, and group pairs of one verification cell, about.
CELL_MEMBERS, GROUP_MEMBERS, CELL_PAIRS = 1024, 64, 200_000
#: Shingles that one local count covers; the sketch holds those that it saw more than once. It only orders
#: shingles, for which any order is right.
LOCAL_SHINGLES = 2_000_000
#: Rows of the sketch, and shingles of whole sets, that go to Spark in one batch, about.
OUT_ROWS, OUT_SHINGLES = 1 << 16, 1 << 19


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    w = text.lower().split()
    if not w:
        return np.empty(0, np.uint64)
    return np.unique(gram_hashes(word_hashes(w), min(words, len(w))))


def needed(a, b, percent: int):
    """Least intersection of two sets of these sizes that links them."""
    return -(-percent * (a + b) // (100 + percent))


def _sketch_rows(words: int):
    def run(batches):
        counts, held, n = np.zeros(SKETCH, np.int64), np.empty(LOCAL_SHINGLES + OUT_ROWS, np.uint64), 0

        def flush():
            # in place and in blocks: a few arrays of this size would be most of the worker's memory
            own = held[:n]
            own.sort()
            same = own[1:] == own[:-1]
            repeats = np.zeros(n, bool)
            repeats[1:] = same
            repeats[:-1] |= same
            for at in range(0, n, OUT_ROWS):
                u = own[at:at + OUT_ROWS][repeats[at:at + OUT_ROWS]]
                np.add.at(counts, (u & np.uint64(SKETCH - 1)).astype(np.int64), 1)

        for b in batches:
            for t in b.column(0):
                u = shingles(t.as_py(), words)
                if n + len(u) > len(held):
                    held = np.concatenate([held[:n], u])
                held[n:n + len(u)] = u
                n += len(u)
                if n >= LOCAL_SHINGLES:
                    flush()
                    n = 0
        if n:
            flush()
        found = np.nonzero(counts)[0]
        for i in range(0, len(found), OUT_ROWS):
            at = found[i:i + OUT_ROWS]
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["slot", "n"])

    return run


def frequency_sketch(rows: DataFrame, words: int = WORDS) -> np.ndarray:
    """The power of two of each slot's count; its size is fixed, whatever the number of documents."""
    found = rows.select("text").mapInArrow(released(_sketch_rows(words)), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).where("n >= 8")
    table = found.select("slot", F.floor(F.log2("n")).cast("byte").alias("power")).toArrow()
    out = np.zeros(SKETCH, np.uint8)
    out[table.column("slot").to_numpy()] = table.column("power").to_numpy()
    return out


SETS_DDL = "doc_id long, rk long, n long, h1 long, h2 long, pk long, prefix array<long>"
SETS = pa.schema([("doc_id", pa.int64()), ("rk", pa.int64()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("pk", pa.int64()), ("prefix", pa.list_(pa.int64()))])


def set_hash(u: np.ndarray, seed: int = 0) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(u.tobytes(), seed)).view(np.int64))


def _sets(shared, words: int, percent: int):
    def run(batches):
        powers = shared.value
        for b in batches:
            n, h1, h2, pk, flat, off = [], [], [], [], [], [0]
            for t in b.column(2):
                u = shingles(t.as_py(), words)
                size = len(u)
                length = size - -(-percent * size // 100) + 1 if size else 0
                order = np.lexsort((u, powers[(u & np.uint64(SKETCH - 1)).astype(np.int64)]))[:length]
                p = u[order]
                n.append(size)
                h1.append(set_hash(u) if size else None)
                h2.append(set_hash(u, 1) if size else None)
                pk.append(set_hash(p, 2) if size else None)
                flat.append(p)
                off.append(off[-1] + length)
            values = np.concatenate(flat).view(np.int64) if flat else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(values))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(pk, pa.int64()), lists], schema=SETS)

    return run


def _tokens(groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(token, cell, gid, np) for each prefix shingle of groups and each of its cells, and the stored frame to drop.

    The cells of a shingle of many groups are pairs of blocks. Such shingles are at most one in
    CELL_MEMBERS rows.
    """
    token = F.posexplode("prefix").alias("pos", "token")
    hot = groups.select(F.explode("prefix").alias("token")).groupBy("token").agg(F.ceil(F.count("*") / CELL_MEMBERS).alias("blocks")).where("blocks > 1")
    hot = stored(hot, "hot")
    # size and position share one column: both are at most the words of a text
    rows = groups.select("gid", "n", token).select("token", "gid", F.shiftleft("n", 31).bitwiseOR(F.col("pos").cast("long")).alias("np"))
    own, other = F.pmod("gid", "blocks"), F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("blocks", F.lit(1).cast("long")) - 1)).alias("other")
    spread = rows.join(maybe_broadcast(hot, hot.count(), 32), "token", "left").select("token", "gid", "np", F.coalesce(own, F.lit(0)).alias("own"), other)
    cell = F.shiftleft(F.least("own", "other"), 31).bitwiseOR(F.greatest("own", "other"))
    return spread.select("token", cell.alias("cell"), "gid", "np"), hot


LISTS = pa.schema([("node", pa.int64()), ("partners", pa.list_(pa.int64())), ("low", pa.int64())])
LISTS_DDL = "node long, partners array<long>, low long"


def _lists(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """For every node of the pairs (a < b): its greater partners, and its least partner or itself."""
    pairs = np.unique(np.stack([a, b], axis=1), axis=0) if len(a) else np.empty((0, 2), np.int64)
    nodes = np.unique(pairs)
    start, stop = np.searchsorted(pairs[:, 0], nodes), np.searchsorted(pairs[:, 0], nodes, side="right")
    low = nodes.copy()
    np.minimum.at(low, np.searchsorted(nodes, pairs[:, 1]), pairs[:, 0])
    off = np.concatenate([[0], np.cumsum(stop - start)])
    return pa.RecordBatch.from_arrays([pa.array(nodes), pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(pairs[:, 1].copy())), pa.array(low)], schema=LISTS)


def _partners(percent: int):
    """Rows in order of (token, cell, size) -> candidate lists."""

    def pairs_of(token, cell, gid, size_pos):
        n, left = size_pos >> 31, (size_pos >> 31) - (size_pos & ((1 << 31) - 1))
        new = np.concatenate([[True], (token[1:] != token[:-1]) | (cell[1:] != cell[:-1])])
        end = np.concatenate([np.nonzero(new)[0][1:], [len(token)]])[np.cumsum(new) - 1]
        at, d = np.arange(len(token)), 0
        while len(at):
            d += 1
            at = at[at + d < end[at]]
            at = at[100 * n[at] >= percent * n[at + d]]  # sizes rise within a cell
            ok = np.minimum(left[at], left[at + d]) >= needed(n[at], n[at + d], percent)
            x, y = gid[at[ok]], gid[at[ok] + d]
            yield np.minimum(x, y), np.maximum(x, y)

    def run(batches):
        held, a, b, n = None, [], [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy() for i in range(4)]
            if held is not None:
                cols = [np.concatenate([h, c]) for h, c in zip(held, cols)]
            # the last cell may go on in the next batch
            last = np.nonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))[0]
            cut = last[-1] + 1 if len(last) else 0
            held = [c[cut:] for c in cols]
            for x, y in pairs_of(*[c[:cut] for c in cols]) if cut else ():
                a.append(x)
                b.append(y)
                n += len(x)
                if n > 2_000_000:
                    yield _lists(np.concatenate(a), np.concatenate(b))
                    a, b, n = [], [], 0
        for x, y in pairs_of(*held) if held is not None and len(held[0]) else ():
            a.append(x)
            b.append(y)
        if a:
            yield _lists(np.concatenate(a), np.concatenate(b))

    return run


CELLS = pa.schema([("cell", pa.int64()), ("node", pa.int64()), ("partners", pa.list_(pa.int64()))])
CELLS_DDL = "cell long, node long, partners array<long>"


def _layout(batches):
    """Candidate lists with home and block count -> rows of cells: lists, and wanted nodes (no list)."""
    wanted: set[tuple[int, int]] = set()
    for b in batches:
        merged: dict[tuple[int, int], tuple[int, set[int]]] = {}
        for r in b.to_pylist():  # a node's lists come from several shingles
            merged.setdefault((r["home"], r["node"]), (r["blocks"], set()))[1].update(r["partners"])
        out: list[tuple[int, int, list | None]] = []
        for (home, node), (blocks, partners) in merged.items():
            own: dict[int, list[int]] = {}
            for p in partners:
                own.setdefault(p % blocks, []).append(p)
            for j, ps in own.items():
                cell = int(np.uint64(xxhash.xxh3_64_intdigest(f"{home}:{node % blocks}:{j}")).view(np.int64))
                out.append((cell, node, ps))
                for p in (node, *ps):
                    if (cell, p) not in wanted:
                        wanted.add((cell, p))
                        out.append((cell, p, None))
            if len(wanted) > 1_000_000:  # a node may then be wanted twice, which changes nothing
                wanted.clear()
        cell, node, ps = map(list, zip(*out)) if out else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(node, pa.int64()), pa.array(ps, pa.list_(pa.int64()))], schema=CELLS)


def _verify(percent: int, every: bool = False):
    """Rows in order of (cell, lists before sets) -> links: every one, or a spanning forest for each cell."""

    def links(lists, sets):
        root: dict[int, int] = {}
        found: list[tuple[int, int]] = []

        def find(x):
            while (up := root.get(x, x)) != x:
                root[x] = root.get(up, up)
                x = up
            return x

        for a, partners in lists.items():
            for b in sorted(partners):
                members = combinations(sets.get(a, {}).items(), 2) if a == b else product(sets.get(a, {}).items(), sets.get(b, {}).items())
                for (x, u), (y, v) in members:
                    if len(u) > len(v):
                        u, v = v, u
                    least = needed(len(u), len(v), percent)
                    if len(u) < least or not every and find(x) == find(y):
                        continue
                    at = np.searchsorted(v, u)
                    at[at == len(v)] = 0
                    if np.count_nonzero(v[at] == u) < least:
                        continue
                    if every:
                        found.append((min(x, y), max(x, y)))
                    else:
                        rx, ry = find(x), find(y)
                        root[max(rx, ry)] = min(rx, ry)
        return found if every else [(x, find(x)) for x in root if find(x) != x]

    def run(batches):
        now, lists, sets, out = None, {}, {}, []
        for b in batches:
            cells, nodes, partners, h1, arrays = (b.column(i) for i in range(5))
            cells, nodes, h1 = cells.to_pylist(), nodes.to_pylist(), h1.to_pylist()
            for i, cell in enumerate(cells):
                if cell != now:
                    out += links(lists, sets)
                    now, lists, sets = cell, {}, {}
                if h1[i] is None:
                    lists.setdefault(nodes[i], set()).update(partners[i].as_py())
                else:
                    sets.setdefault(nodes[i], {})[h1[i]] = arrays[i].values.to_numpy().view(np.uint64)
            if len(out) > 10_000:
                yield _edges(out)
                out = []
        yield _edges(out + links(lists, sets))

    return run


def _edges(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    u, v = map(list, zip(*rows)) if rows else ([], [])
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


DEALT_DDL = "cell long, node long, partners array<long>, h1 long, shingles array<long>"


def _whole_sets(words: int):
    """Texts of class representatives -> their sets, once for each cell that wants them.

    A row whose key only collides with a representative's is left out.
    """

    def batch(h1, node, rows, flat, off):
        values = np.concatenate(flat).view(np.int64) if flat else np.empty(0, np.int64)
        at = pa.array([i for _, i in rows], pa.int64())
        lists = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(values))
        return pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows], pa.int64()), node.take(at), pa.nulls(len(rows), pa.list_(pa.int64())), h1.take(at), lists], names=["cell", "node", "partners", "h1", "shingles"])

    def run(batches):
        for b in batches:
            h1, node, cells, texts = (b.column(i) for i in range(4))
            rows, flat, off = [], [], [0]
            for i, h in enumerate(h1.to_pylist()):
                u = shingles(texts[i].as_py(), words)
                if len(u) and set_hash(u) == h:
                    for cell in cells[i].as_py():
                        rows.append((cell, i))
                        flat.append(u)
                        off.append(off[-1] + len(u))
                        if off[-1] >= OUT_SHINGLES:
                            yield batch(h1, node, rows, flat, off)
                            rows, flat, off = [], [], [0]
            yield batch(h1, node, rows, flat, off)

    return run


def _dealt(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame, list[DataFrame]]:
    """Sets of all rows, classes of equal sets, the rows of verification cells, and the stored frames to drop."""
    spark = docs.sparkSession
    text_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("rk"), text_bytes().alias("text"))
    shared = spark.sparkContext.broadcast(frequency_sketch(rows, words))
    sets = stored(rows.mapInArrow(released(_sets(shared, words, percent)), SETS_DDL), "sets")
    full = sets.where("n > 0")

    # classes of equal sets, and groups of classes with equal prefix and size, in lots of bounded size
    classes = full.groupBy("h1", "h2", "n", "pk").agg(F.min("rk").alias("rk"), F.min("doc_id").alias("doc_id"))
    lots = classes.groupBy("pk", "n").agg(F.ceil(F.count("*") / GROUP_MEMBERS).alias("lots")).where("lots > 1")
    lots_stored = stored(lots, "lots")
    lots = maybe_broadcast(lots_stored, lots_stored.count(), 64)
    lot = F.coalesce(F.pmod("h1", "lots"), F.lit(0)).alias("lot")
    classes = stored(classes.join(lots, ["pk", "n"], "left").select("h1", "h2", "n", "pk", "rk", "doc_id", lot), "classes")
    groups = full.join(lots, ["pk", "n"], "left").select("pk", "n", "h1", "prefix", lot).groupBy("pk", "n", "lot").agg(F.min("h1").alias("gid"), F.first("prefix").alias("prefix"))
    groups = stored(groups.select("gid", "n", "prefix"), "groups")
    ids = classes.groupBy("pk", "n", "lot").agg(F.min("h1").alias("gid"), F.count("*").alias("members"))

    # candidate lists
    tokens, hot = _tokens(groups)
    w = Window.partitionBy("token", "cell")
    met = tokens.withColumn("met", F.count("*").over(w.orderBy("np").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).where("met > 1").drop("met")
    lists = met.mapInArrow(released(_partners(percent)), LISTS_DDL)
    alone = ids.where("members > 1").select(F.col("gid").alias("node"), F.array("gid").alias("partners"), F.col("gid").alias("low"))
    lists = stored(lists.unionByName(alone), "lists")
    drop_stored(groups, hot)

    # cells of bounded work: by the least partner, then blocks of nodes
    home = lists.groupBy("node").agg(F.min("low").alias("home"), F.sum(F.size("partners")).alias("pairs"))
    work = home.groupBy("home").agg(F.ceil(F.sqrt(F.sum("pairs") / CELL_PAIRS)).cast("long").alias("blocks"))
    home = stored(home.join(work, "home").select("node", "home", F.greatest("blocks", F.lit(1)).alias("blocks")), "home")
    laid = lists.where(F.size("partners") > 0).select("node", "partners").join(home, "node").repartition("home", F.pmod("node", "blocks")).mapInArrow(released(_layout), CELLS_DDL)
    laid = stored(laid, "cells")

    # the whole sets of classes that have a partner go to the cells that want them
    cells = laid.where("partners is null").groupBy("node").agg(F.collect_set("cell").alias("cells"))
    wanted = stored(classes.join(ids.select("pk", "n", "lot", F.col("gid").alias("node")), ["pk", "n", "lot"]).join(cells, "node").select("rk", "h1", "node", "cells"), "wanted")
    size = wanted.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size("cells")), F.lit(0)).alias("cells")).first()
    found = rows.select("rk", "text").join(maybe_broadcast(wanted, 1, 64 * size["rows"] + 8 * size["cells"]), "rk").select("h1", "node", "cells", "text")
    sent = found.mapInArrow(released(_whole_sets(words)), DEALT_DDL)
    asked = laid.where("partners is not null").select("cell", "node", "partners", F.lit(None).cast("long").alias("h1"), F.lit(None).cast("array<long>").alias("shingles"))
    dealt = asked.unionByName(sent).repartition("cell").sortWithinPartitions("cell", F.col("h1").asc_nulls_first())
    return sets, classes, dealt, [lots_stored, lists, home, laid, wanted, classes]


def ngram_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (doc_id, text)."""
    sets, classes, dealt, held = _dealt(docs, words, percent)
    label = components(dealt.mapInArrow(released(_verify(percent)), "u long, v long"))

    # the least document of each component, for every row
    named = classes.join(label.withColumnRenamed("node", "h1"), "h1", "left").select("h1", "h2", "n", "doc_id", F.coalesce("label", "h1").alias("label"))
    least = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    by_set = stored(named.join(least, "label").select("h1", "h2", "n", "component_id"), "components")
    drop_stored(*held)
    return sets.select("doc_id", "n", "h1", "h2").join(by_set, ["h1", "h2", "n"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def ngram_links(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Every link: members (doc_id, n_shingles, class_id, n_links) for each row of docs, and links (class_a, class_b).

    Rows with equal sets are one class, named by a hash (null without words); the links are all pairs
    of different classes that are similar enough. n_links counts the other classes that a row's class
    links with.
    """
    sets, classes, dealt, held = _dealt(docs, words, percent)
    links = stored(dealt.mapInArrow(released(_verify(percent, every=True)), "class_a long, class_b long"), "links")
    degree = links.select(F.explode(F.array("class_a", "class_b")).alias("h1")).groupBy("h1").agg(F.count("*").alias("n_links"))
    drop_stored(*held)
    members = sets.select("doc_id", "n", "h1").join(degree, "h1", "left")
    return members.select("doc_id", F.col("n").alias("n_shingles"), F.col("h1").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), links


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of docs without near copies: each component keeps its least document.

    Rows with a null doc_id stay; of rows with the same doc_id all stay or all go.
    """
    gone = stored(ngram_components(docs, words, percent).where("doc_id > component_id").select("doc_id").distinct(), "gone")
    return docs.join(maybe_broadcast(gone, gone.count(), 16), "doc_id", "left_anti").select(*docs.columns)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
sh as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s from w),
st as (select doc_id, count(*) as n, md5(string_agg(s, chr(10) order by s)) as k from sh group by 1),
rep as (select doc_id, n, min(doc_id) over (partition by k) as r from st),
one as (select sh.doc_id, rep.n, sh.s from sh join rep on rep.doc_id = sh.doc_id and rep.r = rep.doc_id),
met as (select a.doc_id as x, b.doc_id as y, a.n as nx, b.n as ny, count(*) as both_n from one a join one b on a.s = b.s and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) group by all),
near as (select x, y from met where 100 * both_n >= 80 * (nx + ny - both_n)),
edges as (select x, y from near union all select y, x from near),
reach(x, y) as (select r, r from (select distinct r from rep) union select reach.x, edges.y from reach join edges on edges.x = reach.y),
comp as (select x, min(y) as component_id from reach group by 1)
select w.doc_id, cast(coalesce(rep.n, 0) as bigint) as n_shingles, coalesce(comp.component_id, w.doc_id) as component_id
from w left join rep on rep.doc_id = w.doc_id left join comp on comp.x = rep.r
"""
