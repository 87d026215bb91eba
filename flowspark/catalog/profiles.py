"""Dataset profiles, class distributions, feature-set comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowspark.catalog.base import DIRTY, dirty_lineitem, query, table
from flowspark.operators import compare, profile


def _pct(expr: str) -> str:
    """SQL text of a percentage with up to four decimals."""
    return f"regexp_replace(printf('%.4f', {expr}), '\\.?0+$', '')"


# The profile of dirty lineitem per line state: tax, quantity, price, discount, constant, constant_text and flag,
# with l_orderkey and l_linenumber. Twelve facts that the profile states, worked out the long way.
PROFILE = f"""WITH {DIRTY},
  base AS (SELECT status, count(*) AS rows_all, count(*) FILTER (NOT absent) AS present, count(*) FILTER (NOT absent AND NOT endless) AS clean,
           count(*) FILTER (tax IS NULL) AS no_tax, count(*) FILTER (quantity IS NULL OR isnan(quantity)) AS no_quantity FROM marked GROUP BY status),
  cls AS (SELECT status, flag, count(*) AS k FROM marked WHERE NOT absent AND NOT endless GROUP BY 1, 2),
  dist AS (SELECT c.status, string_agg(flag || ': ' || k || ' (' || printf('%.2f', k / clean * 100) || '%)', ', ' ORDER BY k DESC, flag) AS classes,
           '{{' || string_agg(flag || ': ' || k || ' (' || {_pct("k / clean * 100")} || '%)', ', ' ORDER BY k DESC, flag) || '}}' AS class_distribution,
           string_agg(flag, ', ' ORDER BY flag) AS labels_list, count(*) AS number_of_labels FROM cls c JOIN base b USING (status) GROUP BY c.status)
  SELECT status, clean AS samples, 8::BIGINT AS features, 4::BIGINT AS float64, 1::BIGINT AS int64, 2::BIGINT AS categorical, 1::BIGINT AS other,
    'constant_text, flag' AS categorical_features, 'tax (' || no_tax || '), quantity (' || no_quantity || ')' AS missing_values,
    number_of_labels, labels_list, classes, class_distribution, rows_all AS original_num_rows, present AS rows_after_nan_removal,
    rows_all - present AS removed_rows_nan, round((rows_all - present) / rows_all, 6) AS removed_rows_nan_proportion,
    clean AS rows_after_inf_removal, present - clean AS removed_rows_inf, clean AS rows_after_nan_inf_removal, rows_all - clean AS removed_rows_nan_inf,
    round((rows_all - clean) / rows_all, 6) AS removed_rows_nan_inf_proportion, clean AS rows_after_preprocessing,
    9::BIGINT AS original_num_features, 8::BIGINT AS features_after_zero_variance_removal, 1::BIGINT AS removed_zero_variance_features,
    round(1 / 9, 6) AS removed_zero_variance_features_proportion, 8::BIGINT AS features_after_preprocessing,
    0::BIGINT AS dropped_non_informative_features, 0.0::DOUBLE AS dropped_non_informative_features_proportion,
    2::BIGINT AS features_transformed_for_experiment, round(2 / 8, 6) AS features_transformed_for_experiment_proportion,
    1::BIGINT AS features_cast_to_float64_int64, 1::BIGINT AS features_encoded_categorical
  FROM base JOIN dist USING (status)"""


@query("a1_dataset_profile", PROFILE)
def dataset_profile(spark, sf_dir):
    return profile.profile(dirty_lineitem(spark, sf_dir), "flag", ["status"])


@query("a2_missing_counts", f"""WITH {DIRTY} SELECT flag, 'tax (' || count(*) FILTER (tax IS NULL) || '), quantity (' ||
  count(*) FILTER (quantity IS NULL OR isnan(quantity)) || ')' AS missing_values FROM dirty GROUP BY flag""")
def missing_counts(spark, sf_dir):
    return profile.missing_counts(dirty_lineitem(spark, sf_dir), ["flag"])


@query("a3_class_distribution", f"""SELECT l_linestatus, l_returnflag AS class, n, n / total * 100 AS pct,
    l_returnflag || ': ' || n || ' (' || printf('%.2f', n / total * 100) || '%)' AS short_text,
    l_returnflag || ': ' || n || ' (' || {_pct("n / total * 100")} || '%)' AS exact_text
  FROM (SELECT l_linestatus, l_returnflag, count(*) AS n, sum(count(*)) OVER (PARTITION BY l_linestatus) AS total FROM lineitem GROUP BY 1, 2)""")
def class_distribution(spark, sf_dir):
    return profile.class_distribution(table(spark, sf_dir, "lineitem"), "l_returnflag", ["l_linestatus"])


@query("a4_distinct_labels", """SELECT lang, count(DISTINCT source) AS number_of_labels, string_agg(DISTINCT source, ', ' ORDER BY source) AS labels_list
  FROM documents GROUP BY lang""")
def distinct_labels(spark, sf_dir):
    return profile.distinct_labels(table(spark, sf_dir, "documents"), "source", ["lang"])


FEATURES = """names AS (SELECT DISTINCT p_brand AS file, lower(unnest(string_split(p_name, ' '))) AS feature FROM part),
  spread AS (SELECT feature, count(*) AS k FROM names GROUP BY 1), files AS (SELECT count(DISTINCT file) AS total FROM names)"""


def _names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_brand", F.explode(F.split("p_name", " ")).alias("word"), "p_type")


@query("a5_feature_coverage", f"""WITH {FEATURES} SELECT file, coalesce(string_agg(feature, ', ' ORDER BY feature) FILTER (k = total), '') AS common,
  coalesce(string_agg(feature, ', ' ORDER BY feature) FILTER (k < total), '') AS extra,
  (SELECT min(k) FROM spread) = (SELECT total FROM files) AS headers_match_all FROM names JOIN spread USING (feature), files GROUP BY file""")
def feature_coverage(spark, sf_dir):
    return compare.feature_coverage(_names(spark, sf_dir), "p_brand", "word")


@query("a5_feature_spread", f"WITH {FEATURES} SELECT feature, k AS n_files FROM spread")
def feature_spread(spark, sf_dir):
    return compare.feature_spread(_names(spark, sf_dir), "p_brand", "word")


@query("a6_step_counts", f"""WITH {DIRTY} SELECT flag, count(*) AS original_num_rows, count(*) FILTER (absent) AS removed_rows_nan,
  count(*) FILTER (NOT absent AND endless) AS removed_rows_inf, count(*) FILTER (NOT absent AND NOT endless) AS rows_after_preprocessing,
  round(count(*) FILTER (absent OR endless) / count(*), 6) AS removed_rows_nan_inf_proportion FROM marked GROUP BY flag""")
def step_counts(spark, sf_dir):
    rows = profile.profile(dirty_lineitem(spark, sf_dir), "status", ["flag"])
    return rows.select("flag", "original_num_rows", "removed_rows_nan", "removed_rows_inf", "rows_after_preprocessing",
                       "removed_rows_nan_inf_proportion")


@query("a7_summary_with_average", f"""WITH {DIRTY}, per_file AS (SELECT flag AS filename, count(*)::DOUBLE AS original_num_rows,
    count(*) FILTER (NOT absent AND NOT endless)::DOUBLE AS rows_after_nan_inf_removal, count(*) FILTER (absent OR endless)::DOUBLE AS removed_rows_nan_inf,
    round(count(*) FILTER (absent OR endless) / count(*), 6) AS removed_rows_nan_inf_proportion, 9.0::DOUBLE AS original_num_features FROM marked GROUP BY flag)
  SELECT coalesce(filename, 'AVERAGE') AS filename, round(avg(original_num_rows), 6) AS original_num_rows,
    round(avg(rows_after_nan_inf_removal), 6) AS rows_after_nan_inf_removal, round(avg(removed_rows_nan_inf), 6) AS removed_rows_nan_inf,
    round(avg(removed_rows_nan_inf_proportion), 6) AS removed_rows_nan_inf_proportion,
    round(avg(rows_after_nan_inf_removal), 6) AS rows_after_preprocessing, round(avg(removed_rows_nan_inf), 6) AS removed_rows,
    round(avg(removed_rows_nan_inf_proportion), 6) AS removed_rows_proportion, avg(original_num_features) AS original_num_features,
    8.0::DOUBLE AS features_after_zero_variance_removal, 1.0::DOUBLE AS removed_zero_variance_features,
    round(1 / 9, 6) AS removed_zero_variance_features_proportion, 8.0::DOUBLE AS features_after_preprocessing, 1.0::DOUBLE AS removed_features,
    round(1 / 9, 6) AS removed_features_proportion, 0.0::DOUBLE AS dropped_non_informative_features,
    0.0::DOUBLE AS dropped_non_informative_features_proportion, 2.0::DOUBLE AS features_transformed_for_experiment,
    0.25::DOUBLE AS features_transformed_for_experiment_proportion, 1.0::DOUBLE AS features_cast_to_float64_int64, 1.0::DOUBLE AS features_encoded_categorical
  FROM per_file GROUP BY ROLLUP (filename)""")
def summary_with_average(spark, sf_dir):
    return profile.preprocessing_summary(profile.profile(dirty_lineitem(spark, sf_dir), "status", ["flag"]), "flag")


@query("a14_s7_chunk_merge", PROFILE)
def chunk_merge(spark, sf_dir):
    """Chunks are described alone, and their merged states give the profile of the whole."""
    df = dirty_lineitem(spark, sf_dir)
    chunks, _ = profile.chunk_bounds(size=7_000_000_000, rows=60_000, threshold=1_000_000_000)
    chunked = df.withColumn("_chunk", F.pmod(F.xxhash64("l_orderkey"), F.lit(chunks)))
    states = profile.profile_state(chunked, "flag", ["_chunk", "status"])
    whole = profile.merge_states(states.drop("_chunk"), ["status"])
    return profile.profile_from_state(whole, df, "flag", ["status"])


PAIRS = f"""WITH {FEATURES}, files_of AS (SELECT p_brand AS g, count(DISTINCT p_type) AS files FROM part GROUP BY 1),
  pairs AS (SELECT a.g AS dataset_a, b.g AS dataset_b, a.files AS files_in_a, b.files AS files_in_b FROM files_of a JOIN files_of b ON a.g < b.g),
  cells AS (SELECT p.*, s.feature, x.file IS NOT NULL AS in_a, y.file IS NOT NULL AS in_b FROM pairs p, spread s
    LEFT JOIN names x ON x.file = p.dataset_a AND x.feature = s.feature LEFT JOIN names y ON y.file = p.dataset_b AND y.feature = s.feature)
  SELECT dataset_a, dataset_b, files_in_a, files_in_b, count(*) FILTER (in_a AND in_b) AS n_common,
    coalesce(string_agg(feature, ', ' ORDER BY feature) FILTER (in_a AND in_b), 'None') AS common_features,
    count(*) FILTER (in_a AND NOT in_b) AS n_extra_a, coalesce(string_agg(feature, ', ' ORDER BY feature) FILTER (in_a AND NOT in_b), 'None') AS extra_features_a,
    count(*) FILTER (in_b AND NOT in_a) AS n_extra_b, coalesce(string_agg(feature, ', ' ORDER BY feature) FILTER (in_b AND NOT in_a), 'None') AS extra_features_b
  FROM cells GROUP BY ALL"""


@query("j4_dataset_pairs", PAIRS)
def dataset_pairs(spark, sf_dir):
    return compare.group_pairs(_names(spark, sf_dir), "p_brand", "word", "p_type")


@query("j4_pairs_seen_from", f"""SELECT if(t, dataset_b, dataset_a) AS dataset_a, if(t, dataset_a, dataset_b) AS dataset_b, if(t, n_extra_b, n_extra_a) AS n_extra_a,
  if(t, extra_features_b, extra_features_a) AS extra_features_a, n_common FROM (SELECT *, dataset_b = 'Brand#2' AS t FROM ({PAIRS}))""")
def pairs_seen_from(spark, sf_dir):
    pairs = compare.pairs_seen_from(compare.group_pairs(_names(spark, sf_dir), "p_brand", "word", "p_type"), "Brand#2")
    return pairs.select("dataset_a", "dataset_b", "n_extra_a", "extra_features_a", "n_common")


@query("x1_run_feature_sets", f"""WITH {FEATURES} SELECT file AS run, coalesce(string_agg(feature, ', ' ORDER BY feature) FILTER (k = total), '') AS common_features,
  coalesce(string_agg(feature, ', ' ORDER BY feature) FILTER (k = 1), '') AS unique_features,
  (SELECT string_agg(feature, ', ' ORDER BY feature) FROM spread) AS union_features FROM names JOIN spread USING (feature), files GROUP BY file""")
def run_feature_sets(spark, sf_dir):
    return compare.run_feature_sets(_names(spark, sf_dir).withColumn("word", F.lower("word")), "p_brand", "word")


