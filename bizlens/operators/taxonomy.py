"""Category operators over the taxonomy.

All matching is turned into equi-joins against tables generated from the
taxonomy (bounded by the taxonomy file, so broadcasting them is safe):

* code patterns: each code emits its prefixes (length 0..len) tagged
  'prefix' plus itself tagged 'exact'; a pattern ``46*`` is the row
  ('46', 'prefix'), a pattern ``56111`` the row ('56111', 'exact');
* substring search: every substring of every lower-cased label/keyword.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizlens.functions.cleaning import strip_ws


def patterns(cats: DataFrame) -> DataFrame:
    """(category_id, value, kind) for every code pattern of every category."""
    p = cats.select(F.col("id").alias("category_id"), F.explode("ssic").alias("pattern"))
    is_prefix = F.col("pattern").endswith("*")
    return p.select(
        "category_id",
        F.when(is_prefix, F.expr("substring(pattern, 1, length(pattern) - 1)"))
        .otherwise(F.col("pattern")).alias("value"),
        F.when(is_prefix, F.lit("prefix")).otherwise(F.lit("exact")).alias("kind"),
    ).distinct()


def code_keys(codes: DataFrame, code_col: str, carry=()) -> DataFrame:
    """Each code's match keys: its prefixes (kind 'prefix') and itself ('exact')."""
    c = F.col(code_col)
    keys = F.concat(
        F.transform(F.sequence(F.lit(0), F.length(c)),
                    lambda n: F.struct(F.substring(c, 1, n).alias("value"), F.lit("prefix").alias("kind"))),
        F.array(F.struct(c.alias("value"), F.lit("exact").alias("kind"))),
    )
    return codes.select(code_col, *carry, F.inline(keys))


def code_categories(codes: DataFrame, cats: DataFrame, code_col: str = "code") -> DataFrame:
    """(code, category_id) for every distinct non-NULL code matching any pattern."""
    distinct_codes = codes.select(code_col).filter(F.col(code_col).isNotNull()).distinct()
    keys = code_keys(distinct_codes, code_col)
    return keys.join(F.broadcast(patterns(cats)), ["value", "kind"]).select(code_col, "category_id").distinct()


def category_counts(fact: DataFrame, cats: DataFrame, cond=None, code_col: str = "primary_ssic_norm") -> DataFrame:
    """J6 as a report: rows per category (a row counts once per category even
    if several of the category's patterns match). Every category is listed;
    0 when nothing matches.

    The fact is reduced to (code, count) first (partial aggregate), so the
    pattern join runs on distinct codes, not on rows.
    """
    f = fact.filter(cond) if cond is not None else fact
    per_code = (
        f.groupBy(F.col(code_col).alias("code")).agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("code").isNotNull())
    )
    # per_code has one row per code, so a (code, category) pair appears more
    # than once only when several patterns of one category match it.
    hits = (
        code_keys(per_code, "code", carry=("n",))
        .join(F.broadcast(patterns(cats)), ["value", "kind"])
        .select("code", "n", "category_id").distinct()
        .groupBy("category_id").agg(F.sum("n").alias("n"))
    )
    return (
        cats.select(F.col("id").alias("category_id"), "label")
        .join(hits, "category_id", "left")
        .select("category_id", "label", F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("count"))
    )


def tag_categories(fact: DataFrame, cats: DataFrame, code_col: str = "primary_ssic_norm") -> DataFrame:
    """One row per (fact row, matching category)."""
    mapping = code_categories(fact.select(F.col(code_col).alias("_code")), cats, "_code")
    return fact.join(mapping, fact[code_col] == mapping["_code"]).drop("_code")


def _substrings(text_col):
    """All non-empty substrings of a string column (as an array)."""
    n = F.length(text_col)
    starts = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    return F.flatten(
        F.transform(
            starts,
            lambda s: F.transform(F.sequence(F.lit(1), F.greatest(n - s + 1, F.lit(1))),
                                  lambda k: F.substring(text_col, s, k)),
        )
    )


def search_index(cats: DataFrame) -> DataFrame:
    """(needle, category_id): every substring of each lower-cased label and
    keyword, plus the empty needle for every category (an empty query lists
    them all, as an equi-join rather than a cross product)."""
    texts = cats.select(F.col("id").alias("category_id"), F.lower("label").alias("t")).unionByName(
        cats.select(F.col("id").alias("category_id"), F.explode("keywords").alias("t"))
        .select("category_id", F.lower("t").alias("t"))
    )
    subs = texts.select("category_id", F.explode(_substrings(F.col("t"))).alias("needle"))
    empty = cats.select(F.col("id").alias("category_id"), F.lit("").alias("needle"))
    return subs.unionByName(empty).distinct()


def taxonomy_search(queries: DataFrame, tax_cats: DataFrame, tax_sectors: DataFrame,
                    query_col: str = "query") -> DataFrame:
    """Q10: categories whose label or any keyword contains the (trimmed,
    lower-cased) query, with the sector and its label (fallback: sector id;
    no sector -> 'other'). An empty query lists every category.
    """
    q = queries.select(F.col(query_col).alias("query"), F.lower(strip_ws(F.col(query_col))).alias("needle"))
    hits = q.join(F.broadcast(search_index(tax_cats)), "needle").select("query", "category_id").distinct()
    cats = tax_cats.select(F.col("id").alias("category_id"), F.col("label").alias("category_label"),
                           F.coalesce(F.col("sector"), F.lit("other")).alias("sector"))
    secs = tax_sectors.select(F.col("id").alias("sector"), F.col("label").alias("sector_label"))
    return (
        hits.join(F.broadcast(cats), "category_id")
        .join(F.broadcast(secs), "sector", "left")
        .select("query", "sector", F.coalesce("sector_label", "sector").alias("sector_label"),
                "category_id", "category_label")
    )


def resolve_category(texts: DataFrame, tax_cats: DataFrame, text_col: str = "text") -> DataFrame:
    """Q11: free text -> category: exact label (ci), else exact keyword (ci,
    first category in file order), else all digits -> a typed code, else none.
    """
    t = texts.select(F.col(text_col).alias("text"), strip_ws(F.col(text_col)).alias("v"))
    t = t.withColumn("k", F.lower("v"))
    by_label = tax_cats.groupBy(F.lower("label").alias("k")).agg(F.min_by("id", "pos").alias("label_hit"))
    by_kw = (
        tax_cats.select("pos", "id", F.explode("keywords").alias("kw"))
        .groupBy(F.lower("kw").alias("k"))
        .agg(F.min_by("id", "pos").alias("kw_hit"))
    )
    j = t.join(F.broadcast(by_label), "k", "left").join(F.broadcast(by_kw), "k", "left")
    digits = F.col("v").rlike("^[0-9]+$")
    cat = F.when(F.col("v") == "", F.lit(None)).otherwise(F.coalesce("label_hit", "kw_hit"))
    return j.select(
        "text",
        F.when(F.col("v") == "", F.lit("none"))
        .when(F.col("label_hit").isNotNull(), F.lit("label"))
        .when(F.col("kw_hit").isNotNull(), F.lit("keyword"))
        .when(digits, F.lit("ssic"))
        .otherwise(F.lit("none")).alias("match_type"),
        cat.alias("category_id"),
        F.when(cat.isNull() & digits, F.col("v")).alias("ssic"),
    )
