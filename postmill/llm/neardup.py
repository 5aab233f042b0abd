"""Near duplicates by HyperMinHash.

1. One pass over the texts hashes each document's set of word shingles, and keeps HyperMinHash registers (leading
   zeros and some mantissa bits of the least hash per bucket). Equal sets become one node at once.
2. Registers are banded; nodes with an equal band share a bucket. A node's label is the least node of its buckets,
   and the nodes of a label are dealt into blocks of about BLOCK nodes and BLOCK_SHINGLES shingles, each with the
   label's own node added.
3. In each block, pairs that share a bucket are estimated from their registers (Jaccard, corrected for chance
   collisions), those clearly below the limit go, and the others, best first, are verified on their full sets
   unless they are connected already; only links that connect something are emitted.
4. Connected components of these links. In a bucket that still holds several components, the largest one is done with
   itself: a pair that is left has at least one node outside it. Those outside nodes are dealt into blocks. Two blocks meet
   with those of their nodes that stand in a bucket that both have, and step 3 is done across; then components again.

So no group is ever expanded into pairs of rows: a task holds two blocks at most, bounded in bytes unless one text alone
is larger, and emits fewer links than it has nodes; copies cost one row each, and what a large group costs beyond one pass
grows with its nodes times those outside its largest component. With 32 bands of 4 registers a pair at the
limit of 0.8 shares no bucket with a chance of 5e-8.

Contract. A-Z are lower-cased and words lie between ASCII white space. Texts with fewer words than a shingle are one
shingle; texts without words have none and are linked with nothing, as are rows whose id is null (their component is
null and they are kept). Repeated rows are copies; rows that share an id and no text share a component only through
links, and deduplicated() decides on each row by its own text's component. Texts of any length are used whole. An empty table gives no rows; extra columns are left out, whatever their
names. Nodes and shingles are known by 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import in_small_batches, settled, small_side, stored, whole_text

BLOCK = 256
#: Shingles of the nodes of one block, 8 bytes each.
BLOCK_SHINGLES = 400_000
#: Ids of at most so many documents (8 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 500_000
SIGNED = "doc_id bigint, n bigint, node bigint, registers binary"


def _row_key() -> Column:
    """A row's id and text as one hash; equal for repeated rows."""
    return F.xxhash64(F.col("doc_id").cast("bigint"), whole_text())


def _signed(docs: DataFrame, size: int, with_sets: bool, with_key: bool = False) -> DataFrame:
    """Per document its number of shingles, node and registers; with_sets: the sorted hashes of its set too; with_key: the
    row's key too."""

    def sign(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        from postmill.llm import shingles

        for batch in batches:
            n, nodes, registers, sets = [], [], [], []
            for own in shingles.shingle_sets((x.as_buffer().to_pybytes() for x in batch.column(1)), size):
                raw = own.tobytes()
                n.append(len(own))
                nodes.append(int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True))
                registers.append(shingles.registers(own).tobytes() if len(own) else None)
                sets.append(raw if with_sets else None)
            names = ["doc_id", "n", "node", "registers"] + ["hashes"] * with_sets + ["row_key"] * with_key
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(nodes, pa.int64()), pa.array(registers, pa.binary())] + [pa.array(sets, pa.binary())] * with_sets
            columns += [batch.column(2)] if with_key else []
            yield pa.RecordBatch.from_arrays(columns, names)
        settled()

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"), *[_row_key().alias("row_key")] * with_key)
    return in_small_batches(rows).mapInArrow(sign, SIGNED + ", hashes binary" * with_sets + ", row_key bigint" * with_key)


def _banded(nodes: DataFrame) -> DataFrame:
    """key, node for each band of nodes (node, registers)."""

    def band(batches):
        import numpy as np
        import pyarrow as pa

        from postmill.llm import shingles

        for batch in batches:
            if batch.num_rows:
                raw = b"".join(x.as_py() for x in batch.column(1))
                keys = shingles.band_keys(np.frombuffer(raw, np.uint16).reshape(-1, shingles.REGISTERS))
                node = np.repeat(batch.column(0).to_numpy(), shingles.BANDS)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(node)], ["key", "node"])
        settled()

    return nodes.select("node", "registers").mapInArrow(band, "key bigint, node bigint")


def links_of(table, limit: float):
    """Arrow table node, other: verified links that connect nodes of different components, fewer than nodes.

    table: node, component, side, n, registers, hashes; pairs are tried within side 0, or across sides 0 and 1.
    """
    import numpy as np
    import pyarrow as pa

    from postmill.llm import shingles

    node, side = table.column("node").to_numpy(), table.column("side").to_numpy()
    order = np.lexsort((node, side))
    nodes, sides, n = node[order], side[order], table.column("n").to_numpy()[order]
    registers = np.frombuffer(b"".join(table.column("registers").to_pylist()), np.uint16).reshape(-1, shingles.REGISTERS)[order]
    # views of the sets, not copies: they are nearly all that a block weighs
    views = [np.frombuffer(x.as_buffer(), np.uint64) for chunk in table.column("hashes").chunks for x in chunk]
    sets = [views[i] for i in order]
    keys = shingles.band_keys(registers)
    _, component = np.unique(table.column("component").to_numpy()[order], return_inverse=True)
    across = sides.max(initial=0) > 0
    second = int(np.searchsorted(sides, 1))
    first_, second_, estimates = [], [], []
    for i in range(second if across else len(nodes) - 1):
        others = np.arange(second, len(nodes)) if across else np.arange(i + 1, len(nodes))
        fits = (keys[others] == keys[i]).any(1) & (component[others] != component[i])
        fits &= np.minimum(n[others], n[i]) >= limit * np.maximum(n[others], n[i]) - 1e-9
        others = others[fits]
        if len(others):
            estimate = shingles.estimated(registers[others], registers[i], n[others], n[i])
            # the spread of an estimate from the registers that are not borrowed; few of them tell too little
            least = np.minimum(n[others], n[i])
            filled = shingles.REGISTERS * -np.expm1(-least / shingles.REGISTERS)
            likely = (least < 64) | (estimate >= limit - 5.5 * np.sqrt(limit * (1 - limit) / filled))
            first_.append(np.full(likely.sum(), i))
            second_.append(others[likely])
            estimates.append(estimate[likely])
    out: list[tuple[int, int]] = []
    if first_:
        a, b, e = (np.concatenate(x) for x in (first_, second_, estimates))
        parent = list(range(component.max() + 1))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for k in np.argsort(-e, kind="stable"):
            i, j = a[k], b[k]
            p, q = root(component[i]), root(component[j])
            if p == q:
                continue
            few, many = (sets[i], sets[j]) if len(sets[i]) < len(sets[j]) else (sets[j], sets[i])
            at = np.searchsorted(many, few)
            common = int((many[np.minimum(at, len(many) - 1)] == few).sum())
            if 100 * common >= round(100 * limit) * (len(few) + len(many) - common):
                parent[max(p, q)] = min(p, q)
                out.append((int(nodes[i]), int(nodes[j])))
    return pa.table({"node": pa.array([x for x, _ in out], pa.int64()), "other": pa.array([y for _, y in out], pa.int64())})


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) for each node of edges (node, other) that is not the least of its component,
    by turns of large and small stars, until each component is one star.

    Each turn is one aggregation and join by node, and is written, so no lineage grows and a lost executor costs a turn's tasks.
    The result is read from the last turn's table.
    """
    pairs = stored(edges.select(F.greatest("node", "other").alias("u"), F.least("node", "other").alias("v")).where("u <> v").distinct(), "links")
    while not _are_stars(pairs):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: a node's larger neighbours move to its least neighbour
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        # small star: a node and its smaller neighbours move to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        pairs = stored(small, "links")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _are_stars(pairs: DataFrame) -> bool:
    """Whether each node of pairs (u, v), u > v, is either a centre or has one pair to a centre."""
    ends = pairs.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(pairs.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("in")))
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.sum("in").alias("in")).where("out > 1 or (out > 0 and in > 0)").isEmpty()


def near_duplicates(docs: DataFrame, size: int = 5, limit: float = 0.8, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, copies (documents of the node) of each row of docs (doc_id, text)."""
    return _judged(docs, size, limit, block, False)


def _dealt(rows: DataFrame, block: int) -> DataFrame:
    """rows (node, label, n and others) with block: each label's nodes in blocks of about so many nodes and BLOCK_SHINGLES."""
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("n") / BLOCK_SHINGLES))
    sizes = rows.groupBy("label").agg(parts.alias("parts"))
    return rows.join(sizes, "label").withColumn("block", F.xxhash64("label", F.pmod(F.xxhash64("node", F.lit(1)), "parts")))


def _meeting(still: DataFrame, asks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rest, block, node, component, side of the nodes outside (asks: key, node, own, rest) and of those they meet (still: key, node,
    block, component): of two blocks that share a bucket, only the nodes in such a bucket come, each once.

    The blocks of a bucket are one list, so a bucket's nodes are never joined with its blocks row by row.
    """
    blocks = still.groupBy("key").agg(F.collect_set("block").alias("others"))
    rests = asks.groupBy("key").agg(F.collect_set("rest").alias("others"))
    other = F.explode(F.array_distinct(F.flatten(F.collect_list("others"))))
    ours = asks.join(blocks, "key").groupBy("rest", "node", F.col("own").alias("component")).agg(other.alias("block")).withColumn("side", F.lit(0))
    theirs = still.join(rests, "key").groupBy("block", "node", "component").agg(other.alias("rest")).withColumn("side", F.lit(1))
    return ours, theirs


def _judged(docs: DataFrame, size: int, limit: float, block: int, with_key: bool) -> DataFrame:
    """near_duplicates(); with_key: also row_key, and root: the least node of the row's component, or the row's key if it has no shingles."""
    signed = stored(_signed(docs, size, False, with_key), "dup-signed")
    usable = signed.where("doc_id is not null and n > 0")
    nodes = stored(usable.groupBy("node").agg(F.min("doc_id").alias("first_doc"), F.max("n").alias("n"), F.count(F.lit(1)).alias("copies"), F.first("registers").alias("registers")), "dup-nodes")

    buckets = _banded(nodes).groupBy("key").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("members")).where("members > 1").select("key", "pivot")
    members = stored(_banded(nodes).join(buckets, "key").select("key", "node", "pivot"), "dup-members")
    labels = members.groupBy("node").agg(F.min("pivot").alias("label"))
    blocks = stored(_dealt(labels.join(nodes.select("node", "n"), "node"), block).select("node", "label", "block"), "dup-blocks")

    # the full sets of the nodes in buckets, from one document each
    wanted = blocks.join(nodes, "node").select(F.col("first_doc").alias("doc_id")).distinct()
    ids = small_side(wanted, BROADCAST_IDS)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(ids, "doc_id", "left_semi")
    again = _signed(texts, size, True).dropDuplicates(["node"]).join(blocks.select("node"), "node", "left_semi")
    sets = stored(again.select("node", "n", "registers", "hashes"), "dup-sets")

    schema = "node bigint, other bigint"
    alone = blocks.select("block", "node")
    # a label's node joins each of its blocks
    placed = alone.unionByName(blocks.select("block", F.col("label").alias("node")).distinct()).distinct()
    own = placed.join(sets, "node").withColumns({"component": F.col("node"), "side": F.lit(0)})
    first = stored(own.groupBy("block").applyInArrow(lambda t: links_of(t, limit), schema), "dup-links")
    found = components(first)

    home = blocks.join(found, "node", "left").select("node", "label", "block", F.coalesce("component", "node").alias("component"))
    placed = members.select("key", "node").join(home, "node")
    per = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("rows"))
    main = per.groupBy("key").agg(F.max_by("component", F.struct("rows", "component")).alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1").select("key", "main")
    # the nodes of buckets that still hold several components; outside: not of the bucket's largest
    still = stored(placed.join(main, "key").select("key", "node", "label", "block", "component", (F.col("component") != F.col("main")).alias("outside")), "dup-open")
    if not still.isEmpty():
        outer = still.where("outside").select("node", "label", "component").distinct().join(nodes.select("node", "n"), "node")
        outer = stored(_dealt(outer, block).select("node", "component", F.col("block").alias("rest")), "dup-outside")
        asks = stored(still.where("outside").select("key", "node").join(outer.withColumnsRenamed({"component": "own"}), "node").select("key", "node", "own", "rest"), "dup-asks")
        ours, theirs = _meeting(still, asks)
        full = ours.unionByName(theirs).join(sets, "node").select("rest", "block", "side", "node", "component", "n", "registers", "hashes")
        second = stored(full.groupBy("rest", "block").applyInArrow(lambda t: links_of(t, limit), schema), "dup-links")
        if not second.isEmpty():
            found = components(first.unionByName(second))

    # only nodes with links have a component to look up; all others are their own
    whole_stars = found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())
    linked = whole_stars.join(nodes.select("node", "first_doc"), "node")
    least = stored(linked.groupBy("component").agg(F.min("first_doc").alias("component_id")), "dup-least")
    renamed = linked.join(small_side(least, BROADCAST_IDS), "component").select("node", "component_id", "component")
    root = [F.coalesce("component", "node").alias("root")] * with_key
    named = stored(nodes.join(renamed, "node", "left").select("node", F.coalesce("component_id", "first_doc").alias("component_id"), "copies", *root), "dup-named")
    own = ["row_key"] * with_key
    out = signed.select("doc_id", "n", F.when(F.col("n") > 0, F.col("node")).alias("node"), *own).join(named, "node", "left")
    own += [F.coalesce(F.when(F.col("n") > 0, F.col("root")), F.col("row_key")).alias("root")] if with_key else []
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce(F.when(F.col("n") > 0, F.col("component_id")), F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), F.coalesce(F.when(F.col("n") > 0, F.col("copies")), F.lit(1).cast("bigint")).alias("copies"), *own)


def deduplicated(docs: DataFrame, size: int = 5, limit: float = 0.8) -> DataFrame:
    """docs without all but one row of each component; rows with a null id stay. Each row is decided on by its own text:
    an id may stand on rows of several components."""
    judged = stored(_judged(docs, size, limit, BLOCK, True).where("doc_id is not null").select("row_key", "root", "kept"), "dup-judged")
    gone = judged.where("not kept").select("row_key")
    several = judged.where("kept").groupBy("root").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("root")
    if several.isEmpty():
        return _without(docs, gone)
    # the rows among which the least one stays: they share a component and its id
    ties = stored(judged.where("kept").join(several, "root", "left_semi").select("row_key", "root").distinct(), "dup-ties")
    once = _without(docs, gone.unionByName(ties.select("row_key")))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = docs.select(row.alias("row"), _row_key().alias("row_key")).join(ties, "row_key").groupBy("root").agg(F.min("row").alias("row")).select("row.*")
    return once.unionByName(one)


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows whose key is among gone (row_key)."""
    gone = gone.distinct()
    return docs.join(small_side(gone, BROADCAST_IDS), _row_key() == gone["row_key"], "left_anti")
