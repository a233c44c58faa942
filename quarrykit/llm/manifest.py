"""Merkle manifest of a dataset: a tree of digests over each language's rows in order of doc_id, and one over the languages.

How it works at scale:

* Exact ranks without a global sort. A row's key is a string of hexadecimal digits: its doc_id in an order-preserving form, then its leaf
  digest, which separates rows of one doc_id. Rows are counted by their keys' first digits, three more at a time, until no
  prefix of a language holds more than BIN_KEYS keys. Offsets of prefixes are sums of counts over their smaller siblings,
  4,096 at most, added up from the top; a row's rank is its prefix's offset and its place in it. The digits that all keys
  share are left out.
* A rank's digits in base `fanout` are the path to its leaf, so a node is keyed by a prefix of them. Rows are grouped
  by a prefix that leaves some BLOCK_LEAVES of them, whose whole subtree one task folds; the subtrees' roots are the leaves of the next round,
  grouped likewise. Ten billion rows take three rounds, and no group grows with the data or with a hot language.
* Siblings go the other way: a subtree's root gets its own path first, and its leaves add theirs before it.
* All of it is DataFrame functions. What a later step reads twice is written to the shared folder.

Defined cases: null columns are `-` in a leaf; a null lang is a language of its own, before all others; null ids come first in their
language, and rows of one id in order of their leaves; rows equal in all five columns have equal leaves at neighbouring
places, one output row each (they are one key with a number, so a third of all rows being equal makes no hot group);
an empty text isn't null; texts of any length are hashed whole, row by row; an empty table gives no rows; other columns,
whatever their names, aren't read. Languages are ranked in one task: a row a language, not a row a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrykit.llm.common import stored

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 2
#: Digits of a key that are counted at a time, and keys that a counted prefix may hold.
DIGITS, BIN_KEYS = 3, 4096
#: Leaves of a subtree that one task folds, at most.
BLOCK_LEAVES = 4096
_KEY_LENGTH = 1 + 16 + 64


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf_digest(columns: list[Column]) -> Column:
    """The digest of a row's columns, each with its length in bytes before it, so that no two rows of different columns look alike."""
    told = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return digest(F.concat(*told))


def _div(value: Column, by: Column | int) -> Column:
    return F.call_function("div", value, by if isinstance(by, Column) else F.lit(by).cast("long"))


def _key() -> Column:
    """Digits in whose order rows of a language come."""
    flipped = F.lpad(F.hex(F.col("doc_id").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.concat(F.when(F.col("doc_id").isNull(), "0" * 17).otherwise(F.concat(F.lit("1"), flipped)), F.upper("leaf"))


def _shared_digits(least: str, greatest: str) -> int:
    return next((k for k, (a, b) in enumerate(zip(least, greatest, strict=True)) if a != b), len(least) - 1)


def _prefix(length: int) -> Column:
    return F.substring("key", 1, length)


def _counted(keyed: DataFrame, shared: int) -> tuple[DataFrame, int]:
    """(tree, bin, n: rows) of the first prefixes that hold few enough keys, and their length."""
    length = shared
    while True:
        length = min(length + DIGITS, _KEY_LENGTH)
        counts = keyed.groupBy("tree", _prefix(length).alias("bin")).agg(F.count(F.lit(1)).alias("keys"), F.sum("times").alias("n"))
        counts = stored(counts, "manifest-bins")
        if length == _KEY_LENGTH or counts.agg(F.max("keys")).first()[0] <= BIN_KEYS:
            return counts.select("tree", "bin", "n"), length


def _offsets(counts: DataFrame, length: int, shared: int) -> DataFrame:
    """tree, bin, offset: rows of the tree that come before the prefix."""
    if length <= shared:
        return counts.select("tree", "bin", F.lit(0).cast("long").alias("offset"))
    parent = F.substring("bin", 1, max(shared, length - DIGITS))
    earlier = Window.partitionBy("tree", "parent").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    own = counts.withColumn("parent", parent).withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    above = own.groupBy("tree", "parent").agg(F.sum("n").alias("n")).withColumnRenamed("parent", "bin")
    above = _offsets(above, max(shared, length - DIGITS), shared).withColumnRenamed("bin", "parent")
    return own.join(above, ["tree", "parent"]).select("tree", "bin", (F.col("offset") + F.col("before")).alias("offset"))


def ranked(leaves: DataFrame) -> DataFrame:
    """leaves (tree, doc_id, leaf, times; a row for each distinct one) with `start`, the rank of its first row, from 0."""
    keyed = leaves.withColumn("key", _key())
    least, greatest = keyed.agg(F.min("key"), F.max("key")).first()
    shared = _shared_digits(least, greatest)
    counts, length = _counted(keyed, shared)
    earlier = Window.partitionBy("tree", "bin").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("bin", _prefix(length)).join(_offsets(counts, length, shared), ["tree", "bin"])
    return placed.withColumn("start", F.col("offset") + F.coalesce(F.sum("times").over(earlier), F.lit(0))).drop("key", "bin", "offset")


def _levels_of(nodes: Column, fanout: int) -> Column:
    """How many times nodes become their parents until one is left."""
    powers, power = [], 1
    while power < 1 << 62:
        powers.append(power)
        power *= fanout
    return sum((F.when(nodes > F.lit(p).cast("long"), 1).otherwise(0) for p in powers[1:]), F.when(nodes > 1, 1).otherwise(0))


def _parents(nodes: Column, fanout: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(nodes), F.lit(fanout)), lambda at: digest(F.array_join(F.slice(nodes, at, fanout), "")))


def _folded(digests: Column, left: Column, fanout: int, depth: int) -> Column:
    """The levels of a subtree, from its leaves to its root: `depth` of them above the leaves, or as many as its tree has left."""
    steps = F.slice(F.sequence(F.lit(1), F.lit(depth)), F.lit(1), F.least(left, F.lit(depth)))
    return F.aggregate(steps, F.array(digests), lambda levels, _: F.array_append(levels, _parents(F.element_at(levels, -1), fanout)))


def _path(levels: Column, at: Column, fanout: int, depth: int) -> Column:
    """For each level below the root, what stands before and after the leaf's node in its run."""
    powers = F.array(*[F.lit(fanout**k).cast("int") for k in range(depth + 1)])

    def step(nodes: Column, k: Column) -> Column:
        own = _div(at, F.get(powers, k)).cast("int")
        begin = (_div(own, fanout) * fanout).cast("int")
        before = F.slice(nodes, begin + 1, own - begin)
        after = F.slice(nodes, own + 2, begin + (fanout - 1) - own)
        return F.struct(F.array_join(before, "").alias("before"), F.array_join(after, "").alias("after"))

    return F.transform(F.slice(levels, F.lit(1), F.size(levels) - 1), step)


class _Rounds:
    """Subtrees of a forest, round by round. blocks: tree, block, left (levels of the tree from here), items (structs with `digest`)."""

    def __init__(self, blocks: DataFrame, fanout: int, depth: int, rounds: int):
        self.fanout, self.depth = fanout, depth
        self.rounds = [blocks]
        for _ in range(1, rounds):
            self.rounds.append(self._above(self.rounds[-1]))

    def _with_levels(self, blocks: DataFrame) -> DataFrame:
        return blocks.withColumn("levels", _folded(F.transform("items", lambda i: i["digest"]), F.col("left"), self.fanout, self.depth))

    def roots(self, k: int = -1) -> DataFrame:
        """tree, block, left, digest of the subtrees of round k."""
        return self._with_levels(self.rounds[k]).select("tree", "block", F.greatest(F.col("left") - self.depth, F.lit(0)).alias("left"), F.get(F.element_at("levels", -1), F.lit(0)).alias("digest"))

    def _above(self, blocks: DataFrame) -> DataFrame:
        nodes = stored(self.roots(), "manifest-nodes")
        grouped = nodes.groupBy("tree", _div(F.col("block"), self.fanout**self.depth).alias("above"))
        grouped = grouped.agg(F.first("left").alias("left"), F.array_sort(F.collect_list(F.struct(F.col("block").alias("rank"), "digest"))).alias("items"))
        return grouped.withColumnRenamed("above", "block")

    def paths(self, top: DataFrame) -> DataFrame:
        """tree, item, path of every leaf. top: tree, path (from the tree's root on), and more columns, which stay."""
        more = [c for c in top.columns if c not in ("tree", "path")]
        found = top.withColumn("block", F.lit(0).cast("long"))
        for k in range(len(self.rounds) - 1, -1, -1):
            joined = self._with_levels(self.rounds[k]).join(found, ["tree", "block"])
            own = F.transform("items", lambda item, at: F.struct(item.alias("item"), F.concat(_path(F.col("levels"), at, self.fanout, self.depth), F.col("path")).alias("path")))
            exploded = joined.select("tree", *more, F.inline(own))
            found = exploded if k == 0 else exploded.select("tree", *more, F.col("item.rank").alias("block"), "path")
        return found


def manifest(docs: DataFrame, tampered: Column | None = None, fanout: int = FANOUT) -> tuple[DataFrame, str | None]:
    """(doc_id, leaf, tampered, subroot, path of every row; the root, or None for an empty table). path: from the leaf to the root, what stands before and after its
    node among the run's digests. tampered: a leaf to be held against the manifest, null where it is the row's own."""
    if fanout < 2:
        raise ValueError("fanout must be 2 or more")
    rows = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("-")).alias("tree"),  # "-" comes before "="
        "doc_id", leaf_digest([F.col(c) for c in FIELDS]).alias("leaf"), (F.lit(None).cast("string") if tampered is None else tampered).alias("tampered"),
    )
    leaves = stored(rows.groupBy("tree", "doc_id", "leaf", "tampered").agg(F.count(F.lit(1)).alias("times")), "manifest-leaves")
    trees = stored(leaves.groupBy("tree").agg(F.sum("times").alias("n")), "manifest-trees")
    most, languages = trees.agg(F.max("n"), F.count(F.lit(1))).first()
    if not languages:
        none = leaves.select("doc_id", "leaf", "tampered", F.lit(None).cast("string").alias("subroot"), F.array().cast("array<struct<before: string, after: string>>").alias("path"))
        return none, None
    depth = next(k for k in range(20, 0, -1) if k == 1 or fanout**k <= BLOCK_LEAVES)
    rounds = lambda n: next(k for k in range(1, 70) if fanout ** (depth * k) >= n)
    size = fanout**depth

    # A key of many equal rows lies in many blocks: it gives a row for each, with the number of its leaves there.
    end = F.col("start") + F.col("times")
    spread = ranked(leaves).withColumn("block", F.explode(F.sequence(_div(F.col("start"), size), _div(end - 1, size))))
    begin = F.greatest("start", F.col("block") * size)
    pieces = spread.select("tree", "block", F.struct(begin.alias("rank"), (F.least(end, (F.col("block") + 1) * size) - begin).cast("int").alias("times"), "doc_id", F.col("leaf").alias("digest"), "tampered").alias("piece"))
    blocks = pieces.groupBy("tree", "block").agg(F.array_sort(F.collect_list("piece")).alias("pieces"))
    repeated = lambda p: F.array_repeat(F.struct(p["doc_id"].alias("doc_id"), p["digest"].alias("digest"), p["tampered"].alias("tampered")), p["times"])
    blocks = blocks.select("tree", "block", F.flatten(F.transform("pieces", repeated)).alias("items"))
    blocks = stored(blocks.join(trees, "tree").select("tree", "block", _levels_of(F.col("n"), fanout).alias("left"), "items"), "manifest-blocks")
    forest = _Rounds(blocks, fanout, depth, rounds(most))

    subroots = forest.roots().select("tree", "digest")
    of_languages = subroots.withColumn("rank", (F.row_number().over(Window.orderBy("tree")) - 1).cast("long"))
    top = of_languages.groupBy(F.lit("all").alias("tree"), _div(F.col("rank"), size).alias("block")).agg(F.array_sort(F.collect_list(F.struct("rank", F.col("tree").alias("name"), "digest"))).alias("items"))
    top = stored(top.select("tree", "block", _levels_of(F.lit(languages), fanout).alias("left"), "items"), "manifest-languages")
    crown = _Rounds(top, fanout, depth, rounds(languages))
    root = crown.roots().first()["digest"]
    start = docs.sparkSession.createDataFrame([("all", [])], "tree string, path array<struct<before: string, after: string>>")
    per_language = crown.paths(start).select(F.col("item.name").alias("tree"), F.col("item.digest").alias("subroot"), "path")
    found = forest.paths(stored(per_language, "manifest-subroots"))
    return found.select(F.col("item.doc_id").alias("doc_id"), F.col("item.digest").alias("leaf"), F.col("item.tampered").alias("tampered"), "subroot", "path"), root


def siblings(path: Column) -> Column:
    """A proof's digests in order, as text."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["before"], step["after"])), "")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda own, step: digest(F.concat(step["before"], own, step["after"])))


def verified_manifest(docs: DataFrame, fanout: int = FANOUT, every: int = 7) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified. Rows whose id's CRC `every` divides are held against the
    manifest with n_chars one larger."""
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0
    columns = {c: F.col(c) for c in FIELDS} | {"n_chars": F.col("n_chars").cast("decimal(19,0)") + 1}
    proofs, root = manifest(docs, F.when(changed & F.col("n_chars").isNotNull(), leaf_digest(list(columns.values()))), fanout)
    made = proofs.select("doc_id", "leaf", "subroot", F.lit(root).cast("string").alias("root"), digest(siblings(F.col("path"))).alias("proof_sha256"), folded(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root"))
    return made.withColumn("verified", F.col("folded_root") == F.col("root"))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, lang, n_chars, CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id END || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
  || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END AS head, CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS tail FROM documents),
e AS (SELECT *, sha256(head || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars END || tail) AS leaf,
  sha256(head || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1) END || tail) AS other FROM d),
crc_of AS (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS v FROM range(256) r(i)),
crc AS (SELECT DISTINCT doc_id, 0 AS k, CAST(4294967295 AS BIGINT) AS c FROM documents WHERE doc_id IS NOT NULL
  UNION ALL SELECT doc_id, k + 1, xor(v, c // 256) FROM crc JOIN crc_of ON i = xor(c % 256, ascii(substr(CAST(doc_id AS VARCHAR), k + 1, 1))) WHERE k < length(CAST(doc_id AS VARCHAR))),
l AS (SELECT e.doc_id, e.lang, leaf, CASE WHEN xor(c, 4294967295) % 7 = 0 THEN other ELSE leaf END AS other, row_number() OVER (PARTITION BY e.lang ORDER BY e.doc_id NULLS FIRST, leaf) - 1 AS rank,
  count(*) OVER (PARTITION BY e.lang) AS n FROM e LEFT JOIN crc ON crc.doc_id = e.doc_id AND k = length(CAST(e.doc_id AS VARCHAR))),
t AS (SELECT lang, 0 AS lvl, rank AS i, leaf AS h, n AS m FROM l
  UNION ALL SELECT lang, lvl + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (any_value(m) + 1) // 2 FROM t WHERE m > 1 GROUP BY lang, lvl, i // 2),
s AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS rank, count(*) OVER () AS n FROM t WHERE m = 1),
u AS (SELECT 0 AS lvl, rank AS i, subroot AS h, n AS m FROM s UNION ALL SELECT lvl + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (any_value(m) + 1) // 2 FROM u WHERE m > 1 GROUP BY lvl, i // 2),
a AS (SELECT l.lang, l.rank, t.lvl, (l.rank >> t.lvl) % 2 AS side, t.h FROM l JOIN t ON t.lang IS NOT DISTINCT FROM l.lang AND t.i = xor(l.rank >> t.lvl, 1)),
b AS (SELECT s.lang, u.lvl, (s.rank >> u.lvl) % 2 AS side, u.h FROM s JOIN u ON u.i = xor(s.rank >> u.lvl, 1)),
x AS (SELECT lang, max(lvl) AS top FROM t GROUP BY lang), y AS (SELECT max(lvl) AS top, max_by(h, lvl) AS root FROM u),
f AS (SELECT l.lang, l.rank, 0 AS lvl, other AS h FROM l UNION ALL
  SELECT f.lang, f.rank, f.lvl + 1, sha256(CASE WHEN a.h IS NULL THEN f.h WHEN a.side = 0 THEN f.h || a.h ELSE a.h || f.h END)
  FROM f JOIN x ON x.lang IS NOT DISTINCT FROM f.lang LEFT JOIN a ON a.lang IS NOT DISTINCT FROM f.lang AND a.rank = f.rank AND a.lvl = f.lvl WHERE f.lvl < x.top),
g AS (SELECT f.lang, f.rank, 0 AS lvl, f.h FROM f JOIN x ON x.lang IS NOT DISTINCT FROM f.lang AND f.lvl = x.top UNION ALL
  SELECT g.lang, g.rank, g.lvl + 1, sha256(CASE WHEN b.h IS NULL THEN g.h WHEN b.side = 0 THEN g.h || b.h ELSE b.h || g.h END)
  FROM g, y LEFT JOIN b ON b.lang IS NOT DISTINCT FROM g.lang AND b.lvl = g.lvl WHERE g.lvl < y.top),
p AS (SELECT lang, rank, string_agg(h, '' ORDER BY lvl) AS own FROM a GROUP BY ALL), q AS (SELECT lang, string_agg(h, '' ORDER BY lvl) AS own FROM b GROUP BY ALL)
SELECT l.doc_id, l.leaf, s.subroot, y.root, sha256(coalesce(p.own, '') || coalesce(q.own, '')) AS proof_sha256, g.h AS folded_root, g.h = y.root AS verified
FROM l JOIN s ON s.lang IS NOT DISTINCT FROM l.lang, y JOIN g ON g.lvl = y.top AND g.lang IS NOT DISTINCT FROM l.lang AND g.rank = l.rank
LEFT JOIN p ON p.lang IS NOT DISTINCT FROM l.lang AND p.rank = l.rank LEFT JOIN q ON q.lang IS NOT DISTINCT FROM l.lang
"""
