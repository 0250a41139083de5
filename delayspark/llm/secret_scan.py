"""Secret scan with a random forest that removes false positives; DataFrame and ML functions only.

Candidates are runs of 16 or more key characters with a digit.  Each gets the features of the method:
its length; its character transitions (changes between lower case, upper case, digits and marks, and the
share of distinct characters); its dictionary coverage (share of its characters in letter runs that are
words of the corpus, counted over all documents); its path (slashes, dots, an address or a file around it);
and its neighbouring words (hashed, and whether one names a secret or assigns).  A forest trained from
labelled findings gives each candidate the probability of being a secret.

Labelled findings are a table ``label`` (1, 0 or null) beside the features.  :func:`rule_labels` makes
one from high-precision rules; candidates the rules leave open are judged by the forest alone.  The
forest is fitted on at most ``MAX_FIT`` findings of each label (those with the smallest seeded hashes).

Scale: one scan finds candidates inside the row; the dictionary is a map-side combined word count that
candidates' letter runs join by equality, distinct runs first, so no run or word is hot.

Defined results: null and blank texts have no candidate; a candidate that repeats is a finding each time;
without findings of both labels nothing is removed (probability null, secret true); an empty table
gives no row; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import FeatureHasher, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, words_of, written

MAX_FIT = 10_000          # findings of each label that the forest is fitted on
TREES, DEPTH, SEED = 30, 6, 7
HASHED = 64               # places of the neighbouring words
MIN_COUNT = 5             # occurrences that make a letter run a word of the corpus
THRESHOLD = 0.5

# --- fixed values: patterns ----------------------------------------------------------------------
CANDIDATE = r"(?=[A-Za-z_+/=-]*[0-9])[A-Za-z0-9_+/=-]{16,}"
CORPUS_WORD = r"(?<![A-Za-z0-9_])[a-z]{3,}(?![A-Za-z0-9_])"
LETTERS = r"[a-z]{3,}"
SECRET_NAME = (r"(?i)(token|secret|passwd|password|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth|credential|bearer|"
               r"client[_-]?id|session[_-]?key)")
ASSIGNS = r"^(=|:|:=|=>|->)$|[=:]$"
FILE = r"(?i)\.(html?|php|js|css|png|jpe?g|gif|svg|pdf|json|xml|txt|zip|gz)\b"
KNOWN_PREFIX = r"^(AKIA|ASIA|ghp_|gho_|ghs_|xox[abp]-|sk_live_|sk-|AIza|glpat-|eyJ)"


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, word_index, finding`` and the words around: ``word, before2, before1, after1``."""
    def found(words: Column) -> Column:
        marked = F.transform(words, lambda w, i: F.when(F.length(w) >= 16, F.struct(
            i.alias("word_index"), w.alias("word"),
            F.coalesce(F.get(words, i - 2), F.lit("")).alias("before2"),
            F.coalesce(F.get(words, i - 1), F.lit("")).alias("before1"),
            F.coalesce(F.get(words, i + 1), F.lit("")).alias("after1"))))
        return F.filter(marked, lambda s: s.isNotNull() & F.regexp_like(s["word"], F.lit(CANDIDATE)))
    text = F.col(text_col)
    rows = (docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).where(F.regexp_like("text", F.lit(CANDIDATE)))
            .select("doc_id", F.explode(let(words_of(F.col("text")), found)).alias("w")).select("doc_id", "w.*"))
    return rows.withColumn("finding", F.explode(F.regexp_extract_all("word", F.lit(CANDIDATE), F.lit(0))))


def dictionary(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``entry``: lower-case words that occur at least ``MIN_COUNT`` times in all documents."""
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(CORPUS_WORD), F.lit(0))
    return (docs.select(F.explode(words).alias("entry")).groupBy("entry").agg(F.count("*").alias("n"))
            .where(F.col("n") >= MIN_COUNT).select("entry"))


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def _transitions(x: Column) -> Column:
    """Changes between runs of lower case, upper case, digits and marks."""
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(
        x, "[a-z]", "a"), "[A-Z]", "B"), "[0-9]", "0"), "[^aB0]", "-")
    return (F.length(F.regexp_replace(classes, r"(.)\1+", "$1")) - 1).cast("double")


NUMERIC = ["length", "transitions", "transition_share", "distinct_share", "digit_share", "upper_share", "hex", "coverage",
           "longest_run", "slashes", "in_address", "in_file", "named", "assigned", "quoted", "known_prefix"]
NEIGHBOURS = ["n_before2", "n_before1", "n_after1"]


def features(found: DataFrame, words: DataFrame) -> DataFrame:
    """``found`` with the numeric features and the neighbouring words."""
    x = F.col("finding")
    runs = F.regexp_extract_all(F.lower(x), F.lit(LETTERS), F.lit(0))
    # distinct letter runs meet the dictionary; their lengths come back to the distinct findings
    values = found.select("finding").distinct()
    hits = (values.select("finding", F.explode(runs).alias("run")))
    known = hits.select("run").distinct().join(words, F.col("run") == F.col("entry"), "left_semi").withColumnRenamed("run", "k")
    covered = (hits.join(known, F.col("run") == F.col("k")).groupBy("finding")
               .agg(F.sum(F.length("run")).alias("covered")).withColumnRenamed("finding", "f"))
    n = F.length(x).cast("double")
    clean = lambda w: F.lower(F.regexp_replace(w, r"[^A-Za-z_-]", ""))
    context = F.concat_ws(" ", "before2", "before1", F.call_function("substring_index", F.col("word"), F.col("finding"), F.lit(1)))
    rows = found.join(covered, x == F.col("f"), "left")
    return rows.withColumns({
        "length": n, "transitions": _transitions(x), "transition_share": _transitions(x) / n,
        "distinct_share": F.size(F.array_distinct(F.split(x, ""))) / n,
        "digit_share": _count(x, "[0-9]") / n, "upper_share": _count(x, "[A-Z]") / n,
        "hex": F.regexp_like(x, F.lit("^[0-9a-f]+$")).cast("double"),
        "coverage": F.coalesce(F.col("covered"), F.lit(0)) / n,
        "longest_run": F.coalesce(F.array_max(F.transform(F.regexp_extract_all(x, F.lit("[A-Za-z]+"), F.lit(0)),
                                                          lambda r: F.length(r))), F.lit(0)).cast("double"),
        "slashes": _count(F.col("word"), "/"),
        "in_address": F.regexp_like("word", F.lit(r"://|^www\.|@")).cast("double"),
        "in_file": F.regexp_like("word", F.lit(FILE)).cast("double"),
        "named": F.regexp_like(context, F.lit(SECRET_NAME)).cast("double"),
        "assigned": (F.regexp_like("before1", F.lit(ASSIGNS)) | F.regexp_like("word", F.lit(r"^[A-Za-z_.-]+[=:]"))).cast("double"),
        "quoted": F.regexp_like("word", F.lit("[\"'`]")).cast("double"),
        "known_prefix": F.regexp_like(x, F.lit(KNOWN_PREFIX)).cast("double"),
        "n_before2": clean(F.col("before2")), "n_before1": clean(F.col("before1")), "n_after1": clean(F.col("after1")),
    }).drop("f", "covered")


def rule_labels(rows: DataFrame) -> DataFrame:
    """Adds ``label``: 1 for mixed strings assigned to a name of a secret or with a known prefix,
    0 for numbers, words, and parts of addresses and files that nothing assigns, else null."""
    mixed = (F.col("digit_share") > 0.1) & (F.col("digit_share") < 0.9) & (F.col("distinct_share") > 0.2)
    yes = mixed & (F.col("length") >= 20) & (F.col("coverage") < 0.5) & (
        ((F.col("named") == 1) & (F.col("assigned") == 1)) | (F.col("known_prefix") == 1))
    no = (F.col("named") == 0) & (F.col("known_prefix") == 0) & (
        (F.col("digit_share") > 0.95) | (F.col("coverage") > 0.6) | (F.col("in_address") == 1) | (F.col("in_file") == 1))
    return rows.withColumn("label", F.when(yes, 1).when(no, 0))


def _vectors(rows: DataFrame) -> DataFrame:
    hashed = FeatureHasher(inputCols=NEIGHBOURS, outputCol="__words", numFeatures=HASHED).transform(rows)
    return VectorAssembler(inputCols=[*NUMERIC, "__words"], outputCol="__features").transform(hashed).drop("__words")


def fit(labelled: DataFrame):
    """A forest from rows with features and ``label`` (null rows are left out); None without both labels."""
    rows = labelled.where("label is not null")
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows
    if not (sizes.get(0) and sizes.get(1)):
        return None
    draw = F.pmod(F.xxhash64(F.lit("fit"), "doc_id", "word_index", "finding"), F.lit(1 << 40))
    n = F.when(F.col("label") == 1, sizes[1]).otherwise(sizes[0])
    near = rows.withColumn("draw", draw).where(F.col("draw") * n <= F.lit(float(1 << 40)) * (2 * MAX_FIT + 50))
    sample = (near.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy("draw", "finding")))
              .where(F.col("r") <= MAX_FIT).select(*NUMERIC, *NEIGHBOURS, F.col("label").cast("double").alias("label"), "draw"))
    sample = _vectors(written(sample, "secret-fit").orderBy("draw", *NUMERIC).coalesce(1))  # at most 2 * MAX_FIT rows
    forest = RandomForestClassifier(featuresCol="__features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED)
    return forest.fit(sample.select("__features", "label"))


def score(rows: DataFrame, model) -> DataFrame:
    """``rows`` with ``probability`` and ``secret``."""
    if model is None:
        return rows.withColumns({"probability": F.lit(None).cast("double"), "secret": F.lit(True)})
    out = model.transform(_vectors(rows))
    p = vector_to_array("probability")[1]
    return (out.withColumn("__p", p).drop("__features", "rawPrediction", "probability", "prediction")
            .withColumnRenamed("__p", "probability").withColumn("secret", F.col("probability") >= THRESHOLD))


def scan(docs: DataFrame, labels=rule_labels, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, word_index, finding, label, probability, secret`` of every candidate.

    ``labels`` turns the table of features into labelled findings (``label`` 1, 0 or null).
    """
    found = written(candidates(docs, id_col, text_col), "secret-candidates")
    rows = written(labels(features(found, dictionary(docs, text_col))), "secret-features")
    return score(rows, fit(rows)).select("doc_id", F.col("word_index").cast("long").alias("word_index"), "finding",
                                         F.col("label").cast("long").alias("label"), "probability", "secret")
