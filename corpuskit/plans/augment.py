"""Augmentation queries over conversation turns (U family)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import augment as U
from ..session import table
from .catalog import register
from .samples import PAIRS_SQL, _pairs


def _samples(spark, sf):
    p = _pairs(spark, sf)
    return p.select((F.col("channel_id") * 1000000 + F.col("input_ts")).alias("sample_id"), "input", "output")


# Rule tables of these queries.
SYNONYMS = {"the": ["that", "said"], "of": ["from", "within"], "and": ["plus"], "to": ["toward"], "in": ["inside", "amid"],
            "de": ["depuis"], "la": ["cette"], "die": ["jene"], "der": ["jener"]}
TEMPLATES = {"what": ["Topic: {s}", "Notes on {s}", "{s}, in short", "A word about {s}"],
             "how": ["Steps: {s}", "{s}, step by step", "A path to {s}"]}
REWRITES = [(r"\bthe\b", "this"), (r"\band\b", "plus"), (r"\bof\b", "out of")]
TRANSFORMS = [(r"\bthe\b", "this"), (r"\band\b", "plus"), (r"\bof\b", "from"), (r"\bin\b", "amid"), (r"\bde\b", "depuis")]
RULES = {"synonym": SYNONYMS, "template": TEMPLATES, "rewrite": REWRITES, "transform": TRANSFORMS}


def _number_sql(*parts):
    return "(('0x' || substr(sha256(concat_ws(':', '42', " + ", ".join(parts) + ")), 1, 8))::BIGINT % 2147483648)"


def _map_sql(table):
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return "MAP {" + ", ".join(f"{quoted(k)}: [{', '.join(map(quoted, v))}]" for k, v in table.items()) + "}"


SYNONYM_SQL = f"""
WITH p AS ({PAIRS_SQL}),
s AS (SELECT channel_id * 1000000 + input_ts AS sample_id, list_filter(string_split_regex(lower(input), '\\s+'), lambda w: w <> '') AS ws FROM p),
v AS (SELECT sample_id, ws, unnest([0, 1, 2]) AS v FROM s),
w AS (SELECT sample_id, v, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM v),
c AS (SELECT *, regexp_replace(w, '[^\\p{{L}}\\p{{N}}_]', '', 'g') AS clean FROM w),
o AS (SELECT *, {_map_sql(SYNONYMS)}[clean] AS opts FROM c),
h AS (SELECT *, opts IS NOT NULL AND {_number_sql('sample_id', "'synonym'", 'v', 'i', '0')} / 2147483648.0 < 0.3 AS hit FROM o),
r AS (SELECT sample_id, v, i, hit, CASE WHEN hit THEN replace(w, clean, opts[CAST({_number_sql('sample_id', "'pick'", 'v', 'i', '1')} % len(opts) AS INTEGER) + 1]) ELSE w END AS w FROM h),
j AS (SELECT sample_id, v, string_agg(w, ' ' ORDER BY i) AS t, count(*) FILTER (WHERE hit) AS n FROM r GROUP BY 1, 2)
SELECT sample_id, CAST(v AS INTEGER) AS variation, md5(upper(substr(t, 1, 1)) || substr(t, 2)) AS input_md5, CAST(n AS VARCHAR) AS detail FROM j WHERE n > 0"""


@register("augment_synonyms", SYNONYM_SQL)
def augment_synonyms(spark, sf):
    """U-01 synonym variants (3 per pair, p = .3)."""
    return (U.synonym_variants(_samples(spark, sf), SYNONYMS, 3, 0.3)
            .select("sample_id", "variation", F.md5("input").alias("input_md5"), "detail"))


@register("augment_templates")
def augment_templates(spark, sf):
    """U-02 template variants (3 per pair)."""
    return U.template_variants(_samples(spark, sf), TEMPLATES, 3).select("sample_id", "variation", "input", "detail")


def _rewrite_sql():
    cands = ", ".join(f"regexp_replace(input, '(?i){p}', '{r.replace(chr(39), chr(39) * 2)}', 'g')" for p, r in REWRITES)
    return f"""
WITH p AS ({PAIRS_SQL}),
s AS (SELECT channel_id * 1000000 + input_ts AS sample_id, input, [{cands}] AS c FROM p),
k AS (SELECT sample_id, list_filter(c, lambda x, i: lower(x) <> lower(input)
        AND NOT list_contains(list_transform(c[1:i - 1], lambda y: lower(y)), lower(x)))[1:3] AS kept FROM s)
SELECT sample_id, CAST(generate_subscripts(kept, 1) - 1 AS INTEGER) AS variation, unnest(kept) AS input FROM k"""


@register("augment_rewrites", _rewrite_sql())
def augment_rewrites(spark, sf):
    """U-03 rewrite-rule variants (first 3 distinct per pair)."""
    return U.rewrite_variants(_samples(spark, sf), REWRITES, 3).select("sample_id", "variation", "input")


@register("augment_transforms")
def augment_transforms(spark, sf):
    """U-04 transform-pair variants (3 per pair)."""
    return U.transform_variants(_samples(spark, sf), TRANSFORMS, 3).select("sample_id", "variation", "input")


@register("augment_generate")
def augment_generate(spark, sf):
    """U-05 orchestrator: originals + all four strategies (UD-01 registry), confidence >= .8
    (F-01), deduped, shuffled, cut to 3x."""
    s = _samples(spark, sf)
    target = 3 * s.count()
    return U.generate(s, target, RULES, min_confidence=0.8).select("sample_id", "input", "strategy", "confidence")


@register("fixed_variations", """
WITH s AS (SELECT conv_id * 1000 + turn AS sample_id, text AS input, role AS output FROM conversations WHERE text IS NOT NULL),
v AS (SELECT sample_id, input, output, 0 AS ph, 0 AS v FROM s
      UNION ALL SELECT sample_id, lower(input), output, 1, 0 FROM s WHERE lower(input) <> input
      UNION ALL SELECT sample_id, substr(input, 1, length(input) - 1), output, 1, 1 FROM s WHERE suffix(input, '?')
      UNION ALL SELECT sample_id, 'Please ' || lower(input), output, 1, 2 FROM s WHERE NOT starts_with(lower(input), 'please')),
r AS (SELECT *, row_number() OVER (PARTITION BY lower(input) ORDER BY ph, sample_id, v) AS rn FROM v)
SELECT sample_id, input, output, ph AS _ph FROM r WHERE rn = 1""")
def fixed_variations(spark, sf):
    """U-06 profile polite: lower-case, no trailing "?", "Please ..." then keep-first dedup."""
    c = table(spark, sf, "conversations").filter(F.col("text").isNotNull()).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("sample_id"), F.col("text").alias("input"), F.col("role").alias("output"))
    return U.fixed_variations(c, "polite")
