"""Who may read what: effective groups, readable documents, reports.

An empty list of groups means administrators only and is a declaration; null is
none and inherits from the nearest directory above that declares.  A directory
whose settings are broken governs what lies below until the next valid
declaration, and gives no groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ancestors(directory: Column) -> Column:
    """The directory, those above it, and the root (empty string), as an array."""
    parts = F.split(directory, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return F.when(directory == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), above))


def effective_groups(directories: DataFrame, settings: DataFrame, root_groups: list[str] = []) -> DataFrame:
    """``directory, groups, governed_by, broken`` for each distinct directory.

    ``settings`` holds ``path, declared_groups, broken``.
    """
    chain = directories.select("directory").distinct().select("directory", F.posexplode(ancestors(F.col("directory"))).alias("depth", "path"))
    ruling = settings.filter(F.col("broken") | F.col("declared_groups").isNotNull())
    met = chain.join(ruling, "path", "left")
    has = F.col("declared_groups").isNotNull() | F.coalesce("broken", F.lit(False))
    best = met.groupBy("directory").agg(F.max_by(F.struct("path", "declared_groups", "broken"), F.when(has, F.col("depth"))).alias("rule"))
    broken = F.coalesce("rule.broken", F.lit(False))
    default = F.array(*[F.lit(g) for g in root_groups]).cast("array<string>")
    groups = F.when(broken, F.array().cast("array<string>")).otherwise(F.coalesce("rule.declared_groups", default))
    return best.select("directory", F.array_sort(F.array_distinct(groups)).alias("groups"), F.col("rule.path").alias("governed_by"), broken.alias("broken"))


def document_groups(documents: DataFrame, directories: DataFrame) -> DataFrame:
    """``path, groups``: the document's own list replaces that of its directory,
    an empty one too; below broken settings nothing is readable."""
    own = F.when(F.col("broken"), F.array().cast("array<string>")).otherwise(F.coalesce("declared_groups", "groups"))
    return documents.join(directories, "directory").select("path", F.array_sort(F.array_distinct(F.filter(own, lambda g: g.isNotNull()))).alias("groups"))


def nearest_settings(directories: DataFrame, settings: DataFrame) -> DataFrame:
    """``directory, path, name, declared_groups``: the nearest settings at or above each distinct
    directory, whether they declare groups or not; null where there are none."""
    chain = directories.select("directory").distinct().select("directory", F.posexplode(ancestors(F.col("directory"))).alias("depth", "path"))
    found = chain.join(settings.select("path", F.struct("path", "name", "declared_groups").alias("own")), "path", "left")
    best = found.groupBy("directory").agg(F.max_by("own", F.when(F.col("own").isNotNull(), F.col("depth"))).alias("own"))
    return best.select("directory", "own.path", "own.name", "own.declared_groups")


def collection_groups(directories: DataFrame, settings: DataFrame, root_groups: list[str] = []) -> DataFrame:
    """``path, parent, groups``: every directory in use with all above it and the groups that rule it;
    none where broken settings do."""
    tree = collection_tree(directories)
    ruled = effective_groups(tree.select(F.col("path").alias("directory")), settings, root_groups)
    return tree.join(ruled.select(F.col("directory").alias("path"), "groups"), "path")


def collection_tree(directories: DataFrame) -> DataFrame:
    """``path, parent``: every directory in use with all above it."""
    every = directories.select(F.explode(ancestors(F.col("directory"))).alias("path")).distinct()
    parent = F.when(F.col("path") == "", F.lit(None)).otherwise(F.regexp_replace("path", "/?[^/]*$", ""))
    return every.select("path", parent.alias("parent"))


def readable_hits(hits: DataFrame, documents: DataFrame, principals: DataFrame, key: str = "path") -> DataFrame:
    """Hits (``principal`` and ``key``) that the principal may read: a shared group, or an
    administrator.

    Each hit meets the groups of its document and those of its principal, so what is
    moved is bounded by the hits; nothing of the size of documents times principals
    comes about.  Principals without groups read nothing and never reach the join.
    Administrators take a path of their own, never a flag of the shared one.  This
    runs below any Python code that sees texts.  ``documents`` and ``principals`` hold
    one row for each.
    """
    users = principals.filter(~F.col("admin") & (F.size("groups") > 0)).select("principal", F.col("groups").alias("_held"))
    offered = documents.select(F.col("path").alias(key), F.col("groups").alias("_offered"))
    of_users = hits.join(users, "principal").join(offered, key).filter(F.arrays_overlap("_held", "_offered")).select(*hits.columns)
    of_admins = hits.join(principals.filter("admin").select("principal"), "principal", "left_semi")
    return of_users.unionByName(of_admins)


def channel(hits: DataFrame, documents: DataFrame, principals: DataFrame, n: int = 50, overfetch: int = 4) -> tuple[DataFrame, DataFrame]:
    """Filtered candidates, ranked again after the filter, and counts per query.

    ``hits`` holds ``qid, principal, path, score, rank`` with the best
    ``n * overfetch`` of each query.  ``starved``: as many hits as could be fetched,
    and fewer than ``n`` of them readable.
    """
    kept = readable_hits(hits, documents, principals)
    order = Window.partitionBy("qid", "principal").orderBy("rank")
    ranked = kept.withColumn("rank", F.row_number().over(order))
    raw = hits.groupBy("qid", "principal").agg(F.count(F.lit(1)).alias("raw_hits"))
    left = kept.groupBy("qid", "principal").agg(F.count(F.lit(1)).alias("after_acl"))
    counts = raw.join(left, ["qid", "principal"], "left").na.fill(0, ["after_acl"])
    starved = (F.col("raw_hits") == n * overfetch) & (F.col("after_acl") < n)
    return ranked.filter(F.col("rank") <= n), counts.withColumn("starved", starved)


def readers(documents: DataFrame, principals: DataFrame) -> DataFrame:
    """``principal, readable``: documents each principal reads (administrators all).

    Documents are counted by their set of groups first; only the sets in use meet
    the principals."""
    sets = documents.groupBy(F.array_sort(F.array_distinct("groups")).alias("groups")).agg(F.count(F.lit(1)).alias("n"))
    offered = sets.select("groups", "n", F.explode("groups").alias("grp"))
    held = principals.filter(~F.col("admin")).select("principal", F.explode("groups").alias("grp")).distinct()
    read = offered.join(held, "grp").select("principal", "groups", "n").distinct().groupBy("principal").agg(F.sum("n").alias("readable"))
    total = sets.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    count = F.when(F.col("admin"), F.col("total")).otherwise(F.coalesce("readable", F.lit(0)))
    return principals.join(read, "principal", "left").crossJoin(total).select("principal", count.alias("readable"))  # one row


def unreadable(shown: DataFrame, documents: DataFrame, principals: DataFrame) -> DataFrame:
    """Of rows ``principal, path`` those that the principal may not read, found another way than
    ``readable_hits``: by equal groups, one row each, of the documents shown."""
    offered = documents.join(shown.select("path").distinct(), "path", "left_semi").select("path", F.explode("groups").alias("grp"))
    held = principals.select("principal", F.explode("groups").alias("grp"))
    shared = shown.join(offered, "path").join(held, ["principal", "grp"]).select("principal", "path").distinct()
    users = shown.join(principals.filter("admin").select("principal"), "principal", "left_anti")
    return users.join(shared, ["principal", "path"], "left_anti")


def report_text(readable: DataFrame, held: DataFrame, warned: DataFrame) -> str:
    """Who reads what, as text: documents of each principal, of each group with its holders,
    and the warnings (``readable, held, warned``: the frames of those reports).

    Never any text or title of a document; a line per principal, group and kind of
    warning, whose subjects are counted, so that its length does not depend on the
    documents."""
    lines = ["readers"]
    lines += [f"  {r.principal}: {r.readable}" for r in readable.orderBy("principal").toLocalIterator()]
    lines += ["groups"] + [f"  {r.grp}: {r.documents} ({r.holders})" for r in held.orderBy("grp").toLocalIterator()]
    lines += ["warnings"] + [f"  {r.kind}: {r.n}" for r in warned.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).orderBy("kind").toLocalIterator()]
    return "\n".join(lines)


def warnings(documents: DataFrame, principals: DataFrame, collections: DataFrame) -> DataFrame:
    """``kind, subject``: groups of documents that nobody holds, documents for
    administrators only, principals without groups, groups held but never used."""
    used = documents.select(F.explode("groups").alias("subject")).distinct()
    held = principals.filter(~F.col("admin")).select(F.explode("groups").alias("subject")).distinct()
    declared = collections.select(F.explode("groups").alias("subject")).distinct().unionByName(used).distinct()
    kind = lambda name, df: df.select(F.lit(name).alias("kind"), F.col("subject"))
    return (
        kind("unheld group", used.join(held, "subject", "left_anti"))
        .unionByName(kind("admin only", documents.filter(F.size("groups") == 0).select(F.col("path").alias("subject"))))
        .unionByName(kind("no groups", principals.filter(~F.col("admin") & (F.size("groups") == 0)).select(F.col("principal").alias("subject"))))
        .unionByName(kind("unused group", held.join(declared, "subject", "left_anti")))
    )
