"""Expressions, row by row."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleet_queries.base import CATALOG_SQL, catalog, events, query, table
from snapcat.functions import hashing, human, names, periods, sizes
from snapcat.operators.filters import regex_included

HEAD, TAIL = "prod_onsite_", "_daily"


@query(
    CATALOG_SQL + """
SELECT name, dataset, sep AS separator, tag, rel_dataset, 'backup/x' || rel_dataset AS moved, kind, held,
  'tank1|tank1/src|tank1/src/' || split_part(dataset, '/', 3) || '|' || dataset AS parents,
  starts_with(rel_dataset, '/g1/') AS below,
  regexp_full_match(tag, 'prod_onsite_.*_daily') AS in_series, regexp_full_match(tag, 'prod_[1-9][0-9]{3}.*_daily') AS in_bare_series
FROM src"""
)
def scalar_names(spark, sf_dir):
    src = catalog(spark, sf_dir, "src")
    parts = names.split_name(F.col("name"))
    dataset = parts["dataset"]
    return src.select(
        "name", dataset.alias("dataset"), parts["separator"].alias("separator"), parts["tag"].alias("tag"),
        names.relativize(dataset, "tank1/src").alias("rel_dataset"),
        names.replace_prefix(dataset, "tank1/src", "backup/x").alias("moved"),
        names.kind(F.col("name")).alias("kind"),
        names.is_held(F.when(F.col("held"), "2").otherwise("-")).alias("held"),
        F.array_join(names.ancestors(dataset), "|").alias("parents"),
        names.is_descendant(dataset, "tank1/src/g1").alias("below"),
        names.label_matches(F.col("tag"), "prod_", "onsite_", "_daily").alias("in_series"),
        names.label_matches(F.col("tag"), "prod_", "", "_daily").alias("in_bare_series"),
    )


@query(
    r"""
WITH u AS (SELECT page_id, unnest([url, regexp_replace(url, '^[a-z]+://', ''), regexp_extract(url, '^[a-z]+://([^?#]*)', 1),
  regexp_extract(url, '^[a-z]+://[^/]*([^?#]*)', 1), '.' || page_id, 'a b/' || page_id, 'x/./' || page_id, page_id || 'x']) AS name FROM pages)
SELECT DISTINCT name, regexp_matches(name, '^[a-zA-Z]') AND NOT regexp_matches(name, '[\x22''`~!@#$%^&*()+={}\[\]|;<>?,\\]|\t')
  AND NOT contains(name, '//') AND NOT contains(name, '/./') AND NOT contains(name, '/../') AND NOT ends_with(name, '/') AS ok,
  replace(replace(replace(replace(name, ' ', '!'), '..', '!'), '/', '!'), ',', '!') AS safe FROM u"""
)
def scalar_validity(spark, sf_dir):
    url, page = F.col("url"), F.col("page_id").cast("string")
    variants = F.array(
        url, F.regexp_replace(url, "^[a-z]+://", ""), F.regexp_extract(url, "^[a-z]+://([^?#]*)", 1),
        F.regexp_extract(url, "^[a-z]+://[^/]*([^?#]*)", 1), F.concat(F.lit("."), page), F.concat(F.lit("a b/"), page),
        F.concat(F.lit("x/./"), page), F.concat(page, F.lit("x")),
    )
    rows = table(spark, sf_dir, "pages").select(F.explode(variants).alias("name")).distinct()
    return rows.select(
        "name", names.valid_dataset_name(F.col("name")).alias("ok"), names.sanitize_key(F.col("name")).alias("safe")
    )


@query(
    CATALOG_SQL + """
SELECT event_id, CASE event_type WHEN 'error' THEN 60000 WHEN 'click' THEN 3600000 WHEN 'view' THEN 86400000 WHEN 'signup' THEN 604800000
    ELSE 2635200000 END AS label_ms,
  CASE WHEN k = 0 THEN 0 ELSE k END AS amount, CASE WHEN k = 0 THEN '' ELSE 'minutely' END AS unit,
  k * CASE event_type WHEN 'error' THEN 1 WHEN 'click' THEN 1000 WHEN 'view' THEN 3600000 WHEN 'signup' THEN 2635200000 ELSE 31536000000 END AS duration_ms,
  strftime(make_timestamp(creation * 1000000), '%Y-%m-%d_%H:%M:%S') || '+00:00' AS iso, creation AS again, creation - 19800 AS zoned,
  'org_site_' || strftime(ts, '%Y-%m-%d_%H:%M:%S.') || lpad(CAST(epoch_us(ts) // 1000 % 1000 AS VARCHAR), 3, '0') || '_hourly' AS label,
  'n:' || (creation % 360000) // 3600 || ':' || lpad(CAST(creation % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(creation % 60 AS VARCHAR), 2, '0') AS clock
FROM ev"""
)
def scalar_periods(spark, sf_dir):
    ev = events(spark, sf_dir).join(table(spark, sf_dir, "events").select("event_id", "ts"), "event_id")
    kind = F.col("event_type")
    unit = F.when(kind == "error", " millis").when(kind == "click", "seconds").when(kind == "view", "  hours").when(kind == "signup", "months").otherwise(" years")
    text = F.col("k").cast("string")
    iso = periods.iso_from_unix(F.col("creation"))
    parsed = periods.period_parse(F.concat(text, F.lit("minutely")))
    nanos = (F.col("creation") % 360000) * 1_000_000_000 + 999
    return ev.select(
        "event_id",
        periods.label_millis(F.col("tag")).alias("label_ms"),
        parsed["amount"].cast("bigint").alias("amount"),
        parsed["unit"].alias("unit"),
        periods.duration_millis(F.concat(text, unit), strict=True).alias("duration_ms"),
        iso.alias("iso"),
        periods.unix_from_iso(iso).alias("again"),
        periods.unix_from_iso(F.replace(iso, F.lit("+00:00"), F.lit("+05:30"))).alias("zoned"),
        names.render_label(F.lit("org_"), F.lit("site_"), F.col("ts"), F.lit("_hourly"), millis=True).alias("label"),
        F.concat(F.lit("n:"), human.hms(nanos)).alias("clock"),
    )


def sql_float(x: str) -> str:
    def digits(n: int) -> str:
        return f"regexp_replace(regexp_replace(printf('%.{n}f', round_even({x}, {n})), '0+$', ''), '\\.$', '')"

    return f"CASE WHEN {x} < 10 THEN {digits(2)} WHEN {x} < 100 THEN {digits(1)} ELSE printf('%.0f', round_even({x}, 0)) END"


def sql_scaled(x: str, steps: list[tuple[float, float, str]]) -> str:
    cases = " ".join(f"WHEN {x} / {d} < {limit} THEN {sql_float(f'({x} / {d})')} || '{u}'" for d, limit, u in steps[:-1])
    d, _, u = steps[-1]
    return f"CASE {cases} ELSE {sql_float(f'({x} / {d})')} || '{u}' END"


SIZE_STEPS = [(1024.0**i, 1024, " " + u) for i, u in enumerate(("B", "KiB", "MiB", "GiB", "TiB"))]
SQL_TWO_DIGITS = "CASE " + " ".join(
    f"WHEN b < {1024.0 ** (i + 1)} THEN printf('%.2f', round_even(b / {1024.0**i}, 2)) || ' {u}'"
    for i, u in enumerate(("B", "KiB", "MiB", "GiB", "TiB"))
) + " END"
TIME_STEPS = [(1.0, 1000, "ns"), (1e3, 1000, "μs"), (1e6, 1000, "ms"), (1e9, 60, "s"), (6e10, 60, "m"), (3.6e12, 24, "h"), (8.64e13, 1, "d")]


@query(
    CATALOG_SQL + f"""
, n AS (SELECT event_id, k, written0 + 1 AS w, CAST(power(k, 6) AS BIGINT) * 5 + written0 % 7 * 5 + 1 AS t, written0 * k * k * k AS b FROM ev)
SELECT event_id, {sql_scaled('b', SIZE_STEPS)} AS size, {sql_scaled('t', TIME_STEPS)} AS span,
  '-' || {sql_scaled('t', TIME_STEPS)} AS negative_span, k || '/997=' || {sql_float('(k * 100.0 / 997)')} || '%' AS share,
  printf('%.2f', round_even(b / 1048576.0, 2)) || ' MiB' AS mib
FROM n"""
    .replace("printf('%.2f', round_even(b / 1048576.0, 2)) || ' MiB' AS mib", SQL_TWO_DIGITS + " AS mib")
)
def scalar_human(spark, sf_dir):
    k, w = F.col("k"), F.col("written")
    rows = events(spark, sf_dir).select(
        "event_id", "k",
        (F.pow(k, F.lit(6)).cast("bigint") * 5 + w % 7 * 5 + 1).alias("t"), (w * k * k * k).alias("b"),
    )
    return rows.select(
        "event_id",
        human.human_bytes(F.col("b")).alias("size"),
        human.human_duration(F.col("t")).alias("span"),
        human.human_duration(-F.col("t")).alias("negative_span"),
        human.percent(k, F.lit(997), print_total=True).alias("share"),
        human.human_bytes(F.col("b"), precision=2).alias("mib"),
    )


def b64(raw: str) -> str:
    return f"replace(replace(replace(to_base64({raw}), '+', '-'), '/', '_'), '=', '')"


@query(
    f"""
WITH g AS (SELECT event_id, 15813919022682057 + event_id * 997 AS guid, 'tank1/u' || user_id AS dataset FROM events)
SELECT event_id, replace({b64("unhex(lpad(to_hex(guid), 16, '0'))")}, '_', ':') AS compact, CAST(guid AS VARCHAR) AS again,
  {b64("unhex(sha256(dataset))")} AS digest, substr({b64("unhex(sha256(dataset))")}, 1, 21) AS half, substr({b64("unhex(sha256(dataset))")}, 1, 14) AS third,
  {b64("unhex(sha256('site'))")} || '/' || {b64("unhex(sha256(dataset))")} || '/' || substr({b64("unhex(sha256('prod__daily'))")}, 1, 21) AS state_key
FROM g"""
)
def scalar_hashing(spark, sf_dir):
    guid = (F.lit(15813919022682057) + F.col("event_id") * 997).cast("string")
    dataset = F.concat(F.lit("tank1/u"), "user_id")
    compact = hashing.compact_guid(guid)
    return table(spark, sf_dir, "events").select(
        "event_id", compact.alias("compact"), hashing.decimal_guid(compact).alias("again"),
        hashing.sha_key(dataset).alias("digest"), hashing.sha_key(dataset, 2).alias("half"), hashing.sha_key(dataset, 3).alias("third"),
        hashing.state_key(F.lit("site"), dataset, F.lit("prod__daily")).alias("state_key"),
    )


@query(
    """
WITH n AS (SELECT event_id, CAST(floor(value * 100) AS BIGINT) AS w FROM events)
SELECT event_id, CAST(w AS VARCHAR) AS plain, CAST(w * 1024 * 1024 AS VARCHAR) AS mib, CAST(CAST(round_even(w * 1000 / 8.0, 0) AS BIGINT) AS VARCHAR) AS kbit,
  CAST(w * 1048576 + 524288 AS VARCHAR) AS comma, CAST(CAST(w AS HUGEINT) * 1180591620717411303424 AS VARCHAR) AS zib, '0' AS junk FROM n"""
)
def scalar_sizes(spark, sf_dir):
    w = F.floor(F.col("value") * 100).cast("bigint").cast("string")

    def size(*parts):
        return sizes.size_to_bytes(F.concat(*parts)).cast("string")

    return table(spark, sf_dir, "events").select(
        "event_id",
        size(w, F.lit("B foo")).alias("plain"),
        size(w, F.lit(" MiB 0:00:08")).alias("mib"),
        size(w, F.lit("Kb")).alias("kbit"),
        size(w, F.lit(",5MiB")).alias("comma"),
        size(w, F.lit("ZiB")).alias("zib"),
        size(w, F.lit("-2GiB")).alias("junk"),
    )


@query(
    """
WITH l AS (SELECT event_id, CAST(floor(value * 100) AS BIGINT) AS w, CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS BIGINT) AS k FROM events)
SELECT event_id, CASE WHEN k < 5 THEN 0 ELSE w * 1024 END AS bytes,
  CASE WHEN k < 5 THEN 0 WHEN k >= 90 THEN 172839 ELSE k * 60 + 3 END AS remaining,
  CASE WHEN k < 5 THEN '' ELSE '[####....] 51% ETA ' || CASE WHEN k >= 90 THEN '2+0:00:39' ELSE k // 60 || ':' || lpad(CAST(k % 60 AS VARCHAR), 2, '0') || ':03' END
    || ' ETA 09:14:20' END AS tail,
  CASE WHEN w < 1024 THEN printf('%.2f', w * 1.0) || ' B' ELSE printf('%.2f', round_even(w / 1024.0, 2)) || ' KiB' END AS size,
  '[' || CASE WHEN w < 1024 THEN printf('%.2f', w * 1.0) || ' B' ELSE printf('%.2f', round_even(w / 1024.0, 2)) || ' KiB' END || '/s]' AS rate
FROM l"""
)
def scalar_progress(spark, sf_dir):
    k, w = F.col("k"), F.col("w")
    eta = F.when(k >= 90, "2+0:00:39").otherwise(
        F.concat(F.floor(k / 60).cast("string"), F.lit(":"), F.lpad((k % 60).cast("string"), 2, "0"), F.lit(":03"))
    )
    line = F.concat(F.lit("pool 40 GiB: "), w.cast("string"), F.lit("KiB 0:07:31 [ 77MiB/s] [ 64MiB/s] [####....] 51% ETA "), eta, F.lit(" ETA 09:14:20\r"))
    rows = table(spark, sf_dir, "events").select(
        "event_id", F.floor(F.col("value") * 100).cast("bigint").alias("w"), F.regexp_extract("props", '"k": ([0-9]+)', 1).cast("bigint").alias("k")
    )
    parsed = rows.select("event_id", "w", sizes.parse_progress(F.when(k < 5, "no size here").otherwise(line)).alias("p"))
    shown = human.bytes_and_rate(w, F.lit(1_000_000_000))
    return parsed.select(
        "event_id", F.col("p.bytes").cast("bigint").alias("bytes"), F.col("p.remaining_seconds").cast("bigint").alias("remaining"), "p.tail", shown["size"].alias("size"), shown["rate"].alias("rate")
    )


@query(
    """
SELECT p_partkey FROM part WHERE NOT regexp_full_match(p_name, '(?:red|blue).*')
  AND (regexp_full_match(p_brand, 'Brand#1[0-9]*') OR NOT regexp_full_match(p_type, '.*O.*'))"""
)
def regex_lists(spark, sf_dir):
    """Include and exclude lists with a negation."""
    included = regex_included(F.col("p_brand"), ["Brand#1[0-9]*"]) | regex_included(F.col("p_type"), ["!.*O.*"])
    kept = regex_included(F.col("p_name"), [".*"], ["red.*", "blue.*"])
    return table(spark, sf_dir, "part").filter(kept & included).select("p_partkey")
