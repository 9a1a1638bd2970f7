"""Dataset hierarchy: paths of the pages, and dataset trees with exclusions."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleet_queries.base import query, table
from snapcat.operators import filters, tree

# page addresses as a hierarchy: domain parts from the top level down, then the path
PATHS_SQL = r"""
WITH RECURSIVE raw AS (
  SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host,
    regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') AS path FROM pages
), leaf AS (
  SELECT page_id, array_to_string(list_reverse(string_split(host, '.')), '/') || path AS dataset FROM raw
), nodes AS (
  SELECT DISTINCT array_to_string(list_slice(string_split(dataset, '/'), 1, n), '/') AS dataset
  FROM leaf, unnest(range(1, len(string_split(dataset, '/')) + 1)) AS t(n)
)"""


def pages_tree(spark, sf_dir):
    """(page_id, dataset) per page and all nodes of the hierarchy."""
    pages = table(spark, sf_dir, "pages")
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1)
    path = F.regexp_replace(F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^?#]*)", 1), "/+$", "")
    leaf = pages.select(
        "page_id", F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "/"), path).alias("dataset")
    )
    return leaf, tree.complete_tree(leaf.select("dataset"))


@query(PATHS_SQL + "SELECT dataset FROM nodes")
def tree_complete(spark, sf_dir):
    return pages_tree(spark, sf_dir)[1]


@query(
    PATHS_SQL + r"""
, chosen AS (SELECT dataset FROM nodes WHERE regexp_full_match(dataset, '.*/(?:en|fr|blog)(?:/.*)?'))
SELECT dataset FROM chosen c WHERE NOT EXISTS (SELECT 1 FROM chosen a WHERE starts_with(c.dataset, a.dataset || '/'))"""
)
def tree_roots(spark, sf_dir):
    chosen = pages_tree(spark, sf_dir)[1].filter(F.col("dataset").rlike(r"\A.*/(?:en|fr|blog)(?:/.*)?\z"))
    return tree.tree_roots(chosen)


@query(
    PATHS_SQL + r"""
, flagged AS (SELECT dataset FROM nodes WHERE regexp_full_match(dataset, '.*/(?:example|m)/[^/]*[aeiou]'))
SELECT dataset FROM nodes n WHERE NOT EXISTS
  (SELECT 1 FROM flagged f WHERE n.dataset = f.dataset OR starts_with(n.dataset, f.dataset || '/'))"""
)
def tree_prune(spark, sf_dir):
    nodes = pages_tree(spark, sf_dir)[1]
    return tree.prune_subtrees(nodes, nodes.filter(F.col("dataset").rlike(r"\A.*/(?:example|m)/[^/]*[aeiou]\z")))


@query(
    PATHS_SQL + r"""
, selected AS (SELECT dataset FROM nodes WHERE NOT regexp_full_match(dataset, '.*\.html')),
src AS (SELECT dataset FROM nodes WHERE regexp_full_match(dataset, 'com/.*/en/[0-9]*'))
SELECT dataset FROM selected s WHERE NOT EXISTS (SELECT 1 FROM nodes n
    WHERE (n.dataset = s.dataset OR starts_with(n.dataset, s.dataset || '/')) AND n.dataset NOT IN (SELECT dataset FROM selected))
  AND dataset NOT IN (SELECT dataset FROM src)"""
)
def tree_deletable(spark, sf_dir):
    nodes = pages_tree(spark, sf_dir)[1]
    selected = nodes.filter(~F.col("dataset").rlike(r"\.html\z"))
    src = nodes.filter(F.col("dataset").rlike(r"\Acom/.*/en/[0-9]*\z"))
    return tree.deletable_datasets(nodes, selected, src)


@query(
    PATHS_SQL + r"""
, snaps AS (SELECT dataset FROM leaf JOIN pages USING (page_id) WHERE len(html) > 2000)
SELECT dataset FROM nodes s WHERE NOT EXISTS (SELECT 1 FROM snaps n
    WHERE n.dataset = s.dataset OR starts_with(n.dataset, s.dataset || '/'))"""
)
def tree_orphans(spark, sf_dir):
    """Nodes without a long page at or below them."""
    leaf, nodes = pages_tree(spark, sf_dir)
    long = table(spark, sf_dir, "pages").filter(F.length("html") > 2000).select("page_id")
    snaps = leaf.join(long, "page_id").select("dataset", F.lit("snapshot").alias("kind"))
    return tree.orphan_datasets(nodes, nodes, snaps)


@query(
    PATHS_SQL + r"""
, selected AS (SELECT dataset FROM nodes WHERE regexp_full_match(dataset, '(?:com|org)/.*')),
roots AS (SELECT dataset FROM selected c WHERE NOT EXISTS (SELECT 1 FROM selected a WHERE starts_with(c.dataset, a.dataset || '/')))
SELECT 'whole' AS which, dataset FROM roots"""
)
def tree_recursive(spark, sf_dir):
    """Roots of a selection without holes; a selection with holes yields nothing."""
    nodes = pages_tree(spark, sf_dir)[1]
    whole = nodes.filter(F.col("dataset").rlike(r"\A(?:com|org)/.*\z"))
    holes = whole.filter(~F.col("dataset").rlike(r"/[0-9]+\z"))
    first = tree.recursive_roots(whole, nodes).select(F.lit("whole").alias("which"), "dataset")
    return first.unionByName(tree.recursive_roots(holes, nodes).select(F.lit("holes").alias("which"), "dataset"))


@query(
    PATHS_SQL + r"""
SELECT dataset FROM nodes n WHERE dataset NOT IN (SELECT dataset FROM leaf) AND NOT regexp_full_match(dataset, '(?:com|net)(?:/example)?')
UNION SELECT dataset FROM nodes n WHERE EXISTS (SELECT 1 FROM leaf WHERE starts_with(leaf.dataset, n.dataset || '/'))
  AND NOT regexp_full_match(dataset, '(?:com|net)(?:/example)?')"""
)
def tree_missing(spark, sf_dir):
    """Parents to create before the leaves can be copied, with some of the top levels in place."""
    leaf, nodes = pages_tree(spark, sf_dir)
    present = nodes.filter(F.col("dataset").rlike(r"\A(?:com|net)(?:/example)?\z"))
    return tree.missing_ancestors(leaf, present)


@query(
    PATHS_SQL + r"""
, rel AS (SELECT dataset, substr(dataset, length('com') + 1) AS rel FROM nodes WHERE dataset = 'com' OR starts_with(dataset, 'com/'))
SELECT dataset FROM rel WHERE rel <> '' AND regexp_full_match(ltrim(rel, '/'), '(?:example/th.*|example/blog)(?:/.*)?')
  AND NOT regexp_full_match(ltrim(rel, '/'), '(?:(?:.*/)?[Tt][Ee]?[Mm][Pp][-_]?[0-9]*|.*/fr)(?:/.*)?')"""
)
def filter_dataset_names(spark, sf_dir):
    nodes = pages_tree(spark, sf_dir)[1].filter((F.col("dataset") == "com") | F.startswith("dataset", F.lit("com/")))
    patterns = filters.dataset_patterns(["/com/example/blog", "/elsewhere/x"], "com", "backup")
    return filters.filter_datasets(
        tree.relative(nodes, "com"), ["example/th.*"], [filters.DEFAULT_EXCLUDE_DATASETS, ".*/fr"],
        include_datasets=patterns, skip_root=True,
    ).select("dataset")


@query(
    PATHS_SQL + r"""
, props AS (SELECT dataset, CASE WHEN regexp_full_match(dataset, '.*/[0-9]*[02468]') THEN ' False'
    WHEN regexp_full_match(dataset, '.*/fr') THEN 'host2, host3' WHEN regexp_full_match(dataset, '.*/m') THEN 'host2 , host1'
    WHEN regexp_full_match(dataset, '.*/en') THEN '-' ELSE 'TRUE' END AS value FROM nodes),
dropped AS (SELECT dataset FROM props WHERE value IN (' False', 'host2, host3'))
SELECT dataset FROM nodes n WHERE NOT EXISTS
  (SELECT 1 FROM dropped d WHERE n.dataset = d.dataset OR starts_with(n.dataset, d.dataset || '/'))"""
)
def filter_by_host_property(spark, sf_dir):
    nodes = pages_tree(spark, sf_dir)[1]
    name = F.col("dataset")
    value = (
        F.when(name.rlike(r"/[0-9]*[02468]\z"), " False").when(name.rlike(r"/fr\z"), "host2, host3")
        .when(name.rlike(r"/m\z"), "host2 , host1").when(name.rlike(r"/en\z"), "-").otherwise("TRUE")
    )
    props = nodes.select("dataset", F.lit("org:skip").alias("property"), value.alias("value"))
    return filters.filter_by_property(nodes, props, "org:skip", "host1")


@query(
    PATHS_SQL + r"""
, wanted AS (SELECT DISTINCT array_to_string(list_slice(string_split(dataset, '/'), 1, 3), '/') AS dataset
  FROM leaf JOIN pages USING (page_id) WHERE len(html) > 3000)
SELECT dataset FROM nodes n WHERE EXISTS
  (SELECT 1 FROM wanted d WHERE n.dataset = d.dataset OR starts_with(n.dataset, d.dataset || '/'))"""
)
def filter_dataset_table(spark, sf_dir):
    """A long list of datasets as a table instead of patterns."""
    leaf, nodes = pages_tree(spark, sf_dir)
    long = table(spark, sf_dir, "pages").filter(F.length("html") > 3000).select("page_id")
    site = F.substring_index("dataset", "/", 3)
    return filters.filter_dataset_list(nodes, leaf.join(long, "page_id").select(site.alias("dataset")))
