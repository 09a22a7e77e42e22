"""Near-duplicate documents by a chosen-path set similarity join over word shingles.

Documents are branched by minwise tokens: in each of ``trees`` independent trees a node's documents go to
the child named by their least token under that level's hash, and nodes of at most ``leaf`` documents are
compared exhaustively. Two sets of similarity s part at each level with probability 1 - s. Nodes are formed of one
token, of two and of all four; documents that any tree leads past its second level go through ``extra`` further trees, whose
nodes are formed of all four tokens at once. So a pair at the threshold of 0.8
either meets, or parts within two levels in each of the 8 trees (0.36 ** 8), or parts within four levels in
each of the 24 further ones (0.59 ** 24): it is missed with probability 0.00029 at most, at any depth. The
estimate below adds 0.00003.

The comparison at a leaf uses the documents' minwise values (an estimate of similarity) and keeps a
spanning forest of what may be similar, with a margin below the threshold, so a group of copies gives
as many links as documents and never all its pairs. The connected groups of these links are then
compared on the full shingle sets, which alone decide which documents are linked. A group of up to ``block``
members and BLOCK_SHINGLES shingles is compared within one task. In a larger one a member is compared with
all others, chunk by chunk, as the centre of a star; what links to it is the main part, and further members
outside it are tried as centres in turn, ``stars`` times at most. Members that are then still outside are compared
with every member of their group, chunk by chunk. Pairs within the main part need no comparison, so a group
of near copies takes work in proportion to its size. Documents with equal sets are one class from the
start, and a class takes part once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as wh
from .common import drop_staged, staged, table

TREES, LEVELS = 8, 4
EXTRA = 24  # further trees for documents past the second level
LEAF = 64
#: The least share of equal minwise values at which two documents may still be linked: with 32 values
#: more than four standard deviations below the threshold.
MARGIN = 0.5
BLOCK = 500
BLOCK_SHINGLES = 4_000_000  # 8 bytes each
STARS = 4
LAST = 2**63 - 1  # stands for a null id

_seeds = np.random.default_rng(23).integers(1, 2**63, (TREES + EXTRA) * LEVELS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; with fewer words than a shingle, the sequence as one."""
    hashes, first = wh.words(texts, lower=True)
    grams = wh.runs_of(hashes, words)
    out = []
    for a, b in zip(first.tolist(), first[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(grams[a : b - words + 1]))
        else:
            out.append(wh.runs_of(hashes[a:b], b - a) if b > a else hashes[:0])
    return out


SKETCH = "doc long, row long, n_shingles int, one long, two long, minwise binary"


def sketches(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """Rows of SKETCH: set size, two hashes of the whole set, and the minwise values (32 bits each)."""
    for batch in batches:
        for a, b, texts in wh.batches(batch):
            sets = shingle_sets(texts, words)
            one = [int(np.bitwise_xor.reduce(wh.mixed(s)) if len(s) else 0) for s in sets]
            two = [int(np.add.reduce(wh.mixed(s ^ np.uint64(wh.P))) if len(s) else 0) for s in sets]
            low = [minwise(s) for s in sets]
            signed = lambda v: pa.array(np.array(v, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc").slice(a, b - a), batch.column("row").slice(a, b - a), pa.array(map(len, sets), pa.int32()), signed(one), signed(two), pa.array(low, pa.binary())],
                ["doc", "row", "n_shingles", "one", "two", "minwise"],
            )


def minwise(shingles: np.ndarray) -> bytes:
    """For each tree and level the upper 32 bits of the least hash of the set."""
    low = np.full(len(_seeds), 2**64 - 1, np.uint64)
    for at in range(0, len(shingles), 1024):
        x = shingles[at : at + 1024, None] * _seeds
        x ^= x >> np.uint64(32)
        x *= np.uint64(wh.Q)
        np.minimum(low, x.min(axis=0), out=low)
    return (low >> np.uint64(32)).astype("<u4").tobytes()


def forest(frames: Iterator[pd.DataFrame], margin: float, similarity: float) -> Iterator[pd.DataFrame]:
    """Links (a, b) of a spanning forest of what may be similar within each leaf; rows come sorted by node."""

    def leaf(group: pd.DataFrame) -> list[tuple[int, int]]:
        ids, sizes = group["doc"].tolist(), group["n_shingles"].to_numpy()
        values = np.frombuffer(b"".join(group["minwise"]), "<u4").reshape(len(ids), -1)
        root, links = np.arange(len(ids)), []
        for i in range(1, len(ids)):
            close = np.flatnonzero(
                (np.minimum(sizes[:i], sizes[i]) >= similarity * np.maximum(sizes[:i], sizes[i])) & ((values[:i] == values[i]).mean(axis=1) >= margin)
            )
            for r in np.unique(root[close]):
                j = close[root[close] == r][0]
                links.append((ids[j], ids[i]))
                root[root == r] = i
            if len(close):
                root[i] = i
        return links

    held: pd.DataFrame | None = None
    for frame in frames:
        if held is not None:
            frame = pd.concat([held, frame], ignore_index=True)
        starts = np.flatnonzero(np.append(True, frame["node"].to_numpy()[1:] != frame["node"].to_numpy()[:-1])).tolist() if len(frame) else [0]
        links = [x for a, b in zip(starts, starts[1:]) if b - a > 1 for x in leaf(frame.iloc[a:b])]
        held = frame.iloc[starts[-1] :]
        if links:
            yield pd.DataFrame(links, columns=["a", "b"])
    if held is not None and len(held) > 1:
        links = leaf(held)
        if links:
            yield pd.DataFrame(links, columns=["a", "b"])


def components(links: DataFrame, name: str) -> DataFrame:
    """node, root: the least id of each node's component, for the nodes of ``links`` (a, b).

    Each round a node takes the least root about it, and then its root's root, so rounds grow with the
    logarithm of a component's width. A hot node's links meet in partial aggregates before the shuffle.
    """
    both = staged(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), f"{name}-links")
    labels = staged(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"), f"{name}-labels")
    while True:
        about = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
        closer = labels.join(about, labels["node"] == about["a"]).select("node", "root", F.least("root", "near").alias("new"))
        roots = closer.select(F.col("node").alias("new"), F.col("new").alias("far"))
        moved = staged(closer.join(roots, "new", "left").select("node", F.least("new", F.coalesce("far", "new")).alias("root"), (F.col("root") != F.least("new", F.coalesce("far", "new"))).alias("moved")), f"{name}-labels")
        drop_staged(labels)
        labels = moved.select("node", "root")
        if not moved.where("moved").limit(1).count():
            drop_staged(both)
            return labels


def placed_by_tree(classes: DataFrame, trees: range, levels: int, leaf: int, depths: tuple[int, ...]) -> tuple[DataFrame, DataFrame | None]:
    """Leaves (node, size, doc) of the given trees, and the documents (doc) that any of them leads past its second level.

    ``depths`` are the numbers of tokens whose nodes are formed, the last one ``levels``: a document's leaf is its first node of at most ``leaf``
    documents among them, or its last one. Between them nodes are not formed, so a group of near copies, which hardly parts at a level,
    is dealt once for each depth and not once for each level.
    """
    value = lambda i: F.substring("minwise", i * 4 + 1, 4)
    paths = [F.struct(F.lit(t).alias("tree"), F.array(*[value(t * levels + d) for d in range(levels)]).alias("tokens")) for t in trees]
    rows = classes.where("n_shingles > 0").select("doc", F.explode(F.array(*paths)).alias("p")).select("doc", "p.tree", "p.tokens")
    leaves, deep = None, None
    for depth in depths:
        open_rows = rows.withColumn("node", F.xxhash64("tree", *[F.col("tokens")[d] for d in range(depth)]))
        sizes = open_rows.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        placed = staged(open_rows.join(sizes, "node"), "near-nodes")
        done = placed if depth == levels else placed.where(F.col("size") <= leaf)
        done = done.select("node", "size", "doc")
        leaves = done if leaves is None else leaves.unionByName(done)
        if depth == levels:
            break
        rows = placed.where(F.col("size") > leaf).select("doc", "tree", "tokens")
        if not rows.limit(1).count():
            break
        if depth == 2:
            deep = rows.select("doc").distinct()
    return leaves, deep


def may_link(classes: DataFrame, trees: int, levels: int, leaf: int, margin: float, similarity: float, extra: int = EXTRA) -> DataFrame:
    """Links (a, b) between classes whose minwise values leave room for the wanted similarity; negative ids stand for nodes that are large at the last level."""
    leaves, deep = placed_by_tree(classes, range(trees), levels, leaf, tuple(sorted({1, min(2, levels), levels})))
    if deep is not None and extra:
        leaves = leaves.unionByName(placed_by_tree(classes.join(deep, "doc", "left_semi"), range(trees, trees + extra), levels, leaf, (levels,))[0])
    # What is still large at the last level agrees in every token of its path: all of it may be linked, by way of the node. A document is
    # linked to the least of its nodes, and nodes to each other, once for all documents that they share.
    small, large = leaves.where(F.col("size") <= 4 * leaf), leaves.where(F.col("size") > 4 * leaf)
    shared = large.select("doc", (-1 - F.shiftrightunsigned("node", 1)).alias("node")).groupBy("doc").agg(F.collect_set("node").alias("nodes")).withColumn("a", F.array_min("nodes"))
    star = shared.select("a", F.col("doc").alias("b")).unionByName(shared.select("a", F.explode("nodes").alias("b")).where("a <> b").distinct())
    estimate = F.substring("minwise", 1, 4 * trees * levels).alias("minwise")
    sketched = small.select("node", "doc").join(classes.select("doc", "n_shingles", estimate), "doc").repartition("node").sortWithinPartitions("node", "doc")
    close = sketched.select("node", "doc", "n_shingles", "minwise").mapInPandas(partial(forest, margin=margin, similarity=similarity), "a long, b long")
    return close.unionByName(star).distinct()


def sets_of(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """doc, root, parts and the full shingle set of each member (64-bit hashes, sorted); neighbouring rows of a member count once."""
    for batch in batches:
        doc = batch.column("doc").to_numpy()
        batch = batch.filter(pa.array(np.append(True, doc[1:] != doc[:-1]))) if len(doc) else batch
        for a, b, texts in wh.batches(batch):
            packed = pa.array([s.tobytes() for s in shingle_sets(texts, words)], pa.binary())
            yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(a, b - a) for c in ("doc", "root", "parts")], packed], ["doc", "root", "parts", "shingles"])


def linked(ids: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the members of one task: 100 * common >= percent * union, on full sets."""
    sizes = np.array([len(s) for s in sets])
    ends = np.cumsum(sizes)
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1] if len(sets) else np.zeros(0, np.int64)
    split = np.split(codes, ends[:-1])
    root, links, has = np.arange(len(ids)), [], np.zeros(int(codes.max(initial=-1)) + 1, bool)
    for i in range(len(ids)):
        others = np.flatnonzero(root != root[i])
        others = others[(others > i) & (100 * np.minimum(sizes[others], sizes[i]) >= percent * np.maximum(sizes[others], sizes[i]))]
        if not len(others):
            continue
        has[split[i]] = True
        common = np.add.reduceat(has[np.concatenate([split[j] for j in others])], np.cumsum([0, *sizes[others][:-1]]), dtype=np.int64)
        has[split[i]] = False
        for j in others[100 * common >= percent * (sizes[i] + sizes[others] - common)]:
            if root[j] != root[i]:
                links.append((ids[i], ids[j]))
                root[root == root[j]] = root[i]
    return links


def confirm(frames: Iterator[pd.DataFrame], percent: int) -> Iterator[pd.DataFrame]:
    """Confirmed links (a, b) from members sorted by task."""
    held: list[tuple[int, bytes]] = []
    task = None
    for frame in frames:
        out: list[tuple[int, int]] = []
        for key, doc, packed in zip(frame["task"], frame["doc"], frame["shingles"]):
            if key != task:
                out += linked([d for d, _ in held], [np.frombuffer(p, np.uint64) for _, p in held], percent)
                held, task = [], key
            if not held or held[-1][0] != doc:  # rows alike in id and text send the same set
                held.append((doc, packed))
        if out:
            yield pd.DataFrame(out, columns=["a", "b"])
    out = linked([d for d, _ in held], [np.frombuffer(p, np.uint64) for _, p in held], percent)
    if out:
        yield pd.DataFrame(out, columns=["a", "b"])


def star(frames: Iterator[pd.DataFrame], percent: int) -> Iterator[pd.DataFrame]:
    """Links (a, b) of centres to members; rows come sorted by task with the centre first."""
    task, centre, near = None, 0, np.zeros(0, np.uint64)
    for frame in frames:
        out = []
        for key, first, doc, packed in zip(frame["task"], frame["first"], frame["doc"], frame["shingles"]):
            own = np.frombuffer(packed, np.uint64)
            if key != task or first == 0:
                task, centre, near = key, doc, own
            elif doc != centre:
                common = int((near[np.minimum(np.searchsorted(near, own), len(near) - 1)] == own).sum())
                if 100 * common >= percent * (len(near) + len(own) - common):
                    out.append((centre, doc))
        if out:
            yield pd.DataFrame(out, columns=["a", "b"])


def star_links(sets: DataFrame, percent: int, stars: int) -> tuple[DataFrame, DataFrame]:
    """Links of star after star in groups of many parts, and the members (doc, root) left outside the main part.

    ``sets``: doc, root, parts, shingles.
    """
    chunk = F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int")
    state = sets.select("doc", "root").distinct().select("doc", "root", F.lit(False).alias("main"), F.lit(False).alias("used"))
    links = None
    for k in range(stars):
        centres = state.where("not main and not used").groupBy("root").agg(F.min("doc").alias("doc"))
        middle = sets.join(centres, ["doc", "root"]).select("root", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("chunk"), F.lit(0).alias("first"), "doc", "shingles")
        about = sets.join(centres.select("root"), "root", "left_semi").select("root", chunk.alias("chunk"), F.lit(1).alias("first"), "doc", "shingles")
        dealt = middle.unionByName(about).select(F.xxhash64("root", "chunk").alias("task"), "first", "doc", "shingles").repartition("task").sortWithinPartitions("task", "first", "doc")
        found = staged(dealt.mapInPandas(partial(star, percent=percent), "a long, b long"), "near-star")
        links = found if links is None else links.unionByName(found)
        ends = found.select(F.col("b").alias("doc"), F.lit(True).alias("hit")).distinct()
        seen = state.join(ends, "doc", "left").join(centres.select(F.col("root"), F.col("doc").alias("centre")), "root", "left")
        # A star joins the main part if it touches it; the first one is the main part.
        touch = seen.groupBy("root").agg(F.max(F.lit(k == 0) | (F.coalesce("hit", F.lit(False)) & F.col("main"))).alias("touch"))
        mine = F.coalesce("hit", F.lit(False)) | (F.col("doc") == F.col("centre"))
        state = staged(
            seen.join(touch, "root").select("doc", "root", (F.col("main") | (F.col("touch") & F.coalesce(mine, F.lit(False)))).alias("main"), (F.col("used") | F.coalesce(F.col("doc") == F.col("centre"), F.lit(False))).alias("used")), "near-state"
        )
        if state.where("not main and not used").isEmpty():
            break
    return links, state.where("not main").select("doc", "root")


def confirmed_links(sets: DataFrame, percent: int, block: int, stars: int) -> DataFrame:
    """Links (a, b) that keep the members of every group as connected as all their pairs do, on full sets.

    ``sets``: doc, root (the group), parts (1 where the group fits a task), shingles.
    """
    tasks = sets.where("parts = 1").select(F.xxhash64("root").alias("task"), "doc", "shingles")
    large = sets.where("parts > 1")
    links = None
    if not large.isEmpty():
        links, rest = star_links(large, percent, stars)
        outside = rest.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / F.lit(block / 2)).cast("int").alias("rest_parts"))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        part = lambda n: F.pmod(F.xxhash64("doc", F.lit(1)), F.col(n)).cast("int")
        all_members = large.join(outside, "root").select("root", every("rest_parts").alias("x"), part("parts").alias("y"), "doc", "shingles")
        left_out = large.join(rest.select("doc"), "doc", "left_semi").join(outside, "root").select("root", part("rest_parts").alias("x"), every("parts").alias("y"), "doc", "shingles")
        tasks = tasks.unionByName(all_members.unionByName(left_out).select(F.xxhash64("root", "x", "y").alias("task"), "doc", "shingles"))
    dealt = tasks.repartition("task").sortWithinPartitions("task", "doc")
    within = dealt.mapInPandas(partial(confirm, percent=percent), "a long, b long")
    return staged((within if links is None else within.unionByName(links)).where("a <> b"), "near-confirmed")


def near_duplicates(
    docs: DataFrame, words: int = 5, percent: int = 80, trees: int = TREES, levels: int = LEVELS, leaf: int = LEAF, margin: float = MARGIN, block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES, stars: int = STARS
) -> DataFrame:
    """doc_id, row, n_shingles, component_id, kept: the component of each document under the link relation.

    ASCII letters are lower-cased; a document's set holds its distinct shingles of ``words`` words, or
    its whole sequence if it has fewer. Two documents are linked if 100 * common >= percent * union.
    ``component_id`` is the smallest doc_id that links reach, the document's own included, and ``kept``
    marks the document of that id. ``row`` is the hash of the text.

    Defined cases: texts without words have the empty set, are linked with nothing and kept; rows that
    share a doc_id or have none are linked by their texts alone, never by the id; null ids come after all
    others and show as null; of rows with the component's smallest id the text of the least hash is kept;
    other columns are ignored; an empty table gives no rows; a very long text is sketched and compared on all its
    shingles, by one task at a time.
    """
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    sketch = staged(texts.mapInArrow(partial(sketches, words=words), SKETCH), "near-sketch")
    same = ["n_shingles", "one", "two"]
    classes = staged(
        sketch.where("n_shingles > 0").groupBy(*same).agg(F.min(F.struct("doc", "row", "minwise")).alias("r")).select(*same, "r.*", F.monotonically_increasing_id().alias("class")), "near-classes"
    )
    # Links join classes, by a key of their own: ids may be repeated or missing.
    keyed = classes.select(F.col("class").alias("doc"), "n_shingles", "minwise")
    plausible = components(may_link(keyed, trees, levels, leaf, margin, percent / 100), "near-may")
    in_group = plausible.withColumnRenamed("node", "class").join(classes.select("class", "doc", "row", "n_shingles"), "class")
    sizes = in_group.groupBy("root").agg(F.count(F.lit(1)).alias("size"), F.sum("n_shingles").alias("shingles"))
    parts = F.when((F.col("size") <= block) & (F.col("shingles") <= block_shingles), 1).otherwise(F.greatest(F.lit(2), F.ceil(F.col("size") / F.lit(block / 2)), F.ceil(F.col("shingles") / F.lit(block_shingles / 2)))).cast("int")
    members = in_group.join(sizes.select("root", parts.alias("parts")), "root").select("doc", "row", "class", "root", "parts")
    full = texts.join(members, ["doc", "row"]).select(F.col("class").alias("doc"), "root", "parts", "text").mapInArrow(partial(sets_of, words=words), "doc long, root long, parts int, shingles binary")
    sets = staged(full, "near-sets")
    links = confirmed_links(sets, percent, block, stars)
    drop_staged(sets)
    found = components(links, "near-links")
    # A class carries its component's first document (id and text) to its documents.
    rooted = classes.join(found.withColumnRenamed("node", "class"), "class", "left").select(*same, "doc", "row", F.coalesce("root", "class").alias("root"))
    firsts = rooted.groupBy("root").agg(F.min(F.struct("doc", "row")).alias("first"))
    of_class = rooted.select(*same, "root").join(firsts, "root").select(*same, "first")
    first = F.coalesce("first", F.struct("doc", "row"))
    labelled = sketch.select("doc", "row", *same).join(of_class, same, "left").withColumn("first", first).withColumn("component", F.col("first.doc"))
    shown = lambda c: F.when(F.col(c) != LAST, F.col(c))
    return labelled.select(shown("doc").alias("doc_id"), "row", F.col("n_shingles").cast("long").alias("n_shingles"), shown("component").alias("component_id"), ((F.col("doc") == F.col("first.doc")) & (F.col("row") == F.col("first.row"))).alias("kept"))


def without_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The documents of ``docs`` that stay, with all their columns: one of each component, and one of rows alike in id and text."""
    kept = near_duplicates(docs, **options).where("kept").select(F.coalesce("doc_id", F.lit(LAST)).alias("doc"), "row").distinct()
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("row"), F.struct(*docs.columns).alias("own"))
    return keyed.join(kept, ["doc", "row"], "left_semi").dropDuplicates(["doc", "row"]).select(*[F.col("own")[c].alias(c) for c in docs.columns])


def op5_neardup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=2).drop("row")


OP5_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 2 THEN [ws[1]]
             ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n, hash(list_sort(sh)) AS h FROM s),
x AS (SELECT doc_id, unnest(sh) AS t FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM x a JOIN x b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS node, doc_id AS seen FROM n UNION SELECT u.b, r.seen FROM r JOIN u ON u.a = r.node)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, min(r.seen) AS component_id, n.doc_id = min(r.seen) AS kept
FROM n JOIN r ON r.node = n.doc_id GROUP BY n.doc_id, n.n
"""
