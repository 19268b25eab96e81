"""Secret scan with a random forest that removes false positives.

Candidates are values after a name that ends in a key word and an assignment, and long runs of
token characters that hold a digit. The forest judges each by its length, its
character transitions, how much of it dictionary words cover, whether it is
part of a path, and the words beside it. It is trained on labelled findings: a
table of (value, before, after, secret) rows; ``labelled_findings`` makes one
by rule, of the forms that scanners report most, right and wrong.

Built-in column functions and the JVM's random forest only; a scan is one pass
without a shuffle. Training sees the findings alone (``FINDINGS`` rows by
default), never the corpus.

Cases: null and empty texts have no candidate; a null id stays; repeated rows
give repeated findings; very long values are one candidate; an empty table
gives an empty result; columns beyond id and text are not read.
"""

from __future__ import annotations

from collections import Counter

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threshline.llm.common import running_sums

#: Labelled findings that ``labelled_findings`` makes.
FINDINGS = 4000

#: Key words (fixed values).
KEYS = "password|passwd|pwd|secret|token|api[_-]?key|apikey|access[_-]?key|private[_-]?key|auth[_-]?key|credential"
_CHARS = r"A-Za-z0-9+/_.~-"
#: A candidate: a name that ends in a key word, an assignment and a value; or a run of token characters and its padding.
CANDIDATE = rf"""[{_CHARS}]*(?i:{KEYS})["']?\s{{0,3}}(?:=|:|:=|=>)\s{{0,3}}["']?[^\s"'<>]{{6,}}+|[{_CHARS}]{{16,}}+=*+"""

#: Words that make a value look like a name or a sentence (fixed values).
DICTIONARY = "the and with from that this have which their will would about there other these first after under where every great house small again world still night light white black image style class button index script content header footer container wrapper module version release update service client server system config default example sample test user name path file data value list item page home main node module package source build debug info error event click data time date year month price count number order total change table field form input output text font color size width height margin border left right center http https www html json xml com org net".split()
PLACEHOLDER = r"(?i)example|sample|dummy|placeholder|change.?me|your[_-]|xxxx|0000000|1234567|abcdefg|\*\*\*|<|\{\{|\$\{|test"
GOOD_BEFORE = rf"(?i)(?:{KEYS}|bearer|authorization)\W{{0,6}}$"
BAD_BEFORE = r"(?i)(?:commit|sha-?\d*|md5|checksum|hash|digest|uuid|guid|etag|integrity|revision|rev|build|image|layer|object|tree|parent)\W{0,6}$"
ASSIGNED = r"[=:]\s{0,3}[\"']?$"

FEATURES = ("length", "digits", "uppers", "hex", "transitions", "bigrams", "distinct", "consonants", "dictionary", "placeholder", "repeats", "slashes", "dots", "dashes", "extension", "in_path", "uuid", "numeric", "good_before", "bad_before", "assigned", "quoted", "known_prefix")
KNOWN = r"^(?:AKIA|ASIA|ghp_|gho_|github_pat_|xox[baprs]-|sk-|sk_live_|rk_live_|AIza|glpat-|npm_|eyJ)"


def common_pairs(words: list[str] = DICTIONARY, least: int = 3) -> list[str]:
    """Pairs of letters that follow each other in several dictionary words: the transitions of wording."""
    pairs = Counter(w[i : i + 2] for w in words for i in range(len(w) - 1))
    return sorted(p for p, n in pairs.items() if n >= least)


def features(value: Column, before: Column, after: Column) -> dict[str, Column]:
    n = F.greatest(F.length(value), F.lit(1))
    share = lambda pattern: F.regexp_count(value, F.lit(pattern)) / n
    flag = lambda c: c.cast("double")
    words = "|".join(sorted((w for w in DICTIONARY if len(w) > 3), key=lambda w: (-len(w), w)))
    return {
        "length": F.log1p(n),
        "digits": share("[0-9]"),
        "uppers": share("[A-Z]"),
        "hex": flag(value.rlike("^(?i)[0-9a-f]+$")),
        "transitions": share(r"[a-z](?=[0-9A-Z])|[0-9](?=[A-Za-z])|[A-Z](?=[a-z0-9])"),
        "bigrams": F.regexp_count(F.lower(value), F.lit(f"(?=(?:{'|'.join(common_pairs())}))")) / F.greatest(n - 1, F.lit(1)),
        "distinct": F.size(F.array_distinct(F.split(F.left(value, F.lit(64)), ""))) / F.least(n, F.lit(64)),
        "consonants": share("(?i)[bcdfghjklmnpqrstvwxz]{4}"),
        "dictionary": 1 - F.length(F.regexp_replace(F.lower(value), words, "")) / n,
        "placeholder": flag(value.rlike(PLACEHOLDER)),
        "repeats": flag(value.rlike(r"(.)\1{4}")),
        "slashes": share("/"),
        "dots": share(r"\."),
        "dashes": share("[-_]"),
        "extension": flag(value.rlike(r"\.[A-Za-z]{1,4}[0-9]?$")),
        "in_path": flag(before.rlike(r"[/\\][^\s]*$") | after.rlike(r"^[/\\]") | value.rlike("^[~.]*/")),
        "uuid": flag(value.rlike("^(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")),
        "numeric": flag(value.rlike("^[0-9.+-]+$")),
        "good_before": flag(before.rlike(GOOD_BEFORE)),
        "bad_before": flag(before.rlike(BAD_BEFORE)),
        "assigned": flag(before.rlike(ASSIGNED)),
        "quoted": flag(before.rlike("[\"']$")),
        "known_prefix": flag(value.rlike(KNOWN)),
    }


def with_features(findings: DataFrame) -> DataFrame:
    """Adds the vector ``features`` to findings with value, before and after."""
    f = features(F.col("value"), F.col("before"), F.col("after"))
    named = findings.withColumns({f"f_{k}": F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in f.items()})
    return VectorAssembler(inputCols=[f"f_{k}" for k in FEATURES], outputCol="features").transform(named).drop(*[f"f_{k}" for k in FEATURES])


def labelled_findings(spark: SparkSession, n: int = FINDINGS, seed: int = 17) -> DataFrame:
    """(value, before, after, secret): findings of known forms with their verdict, the same for each n and seed."""
    i = F.col("id")
    h = lambda k: F.sha2(F.concat_ws("-", F.lit(str(seed)), F.lit(str(k)), i.cast("string")), 512)
    pick = lambda k, options: F.element_at(F.array(*[F.lit(o) for o in options]), (F.pmod(F.xxhash64(F.lit(seed), F.lit(k), i), F.lit(len(options))) + 1).cast("int"))
    b64 = F.regexp_replace(F.base64(F.unhex(h(1))), "[\r\n=]", "")
    word = pick(3, DICTIONARY)
    # wording that no dictionary has: letters by a rule, half of them vowels
    coined = F.translate(F.left(h(6), F.lit(7)), "0123456789abcdef", "taneliroseumidoa")
    long_words = F.concat(*[F.when(F.pmod(F.xxhash64(F.lit(seed), F.lit(k), F.lit("coined"), i), F.lit(4)) == 0, coined).otherwise(pick(k, DICTIONARY)) for k in range(4, 9)])
    keys = ["token", "api_key", "apiKey", "secret", "password", "client_secret", "ACCESS_KEY", "auth_key"]
    assign = F.concat(pick(10, ["", "the ", "les ", "export ", "const ", "de "]), pick(11, keys), pick(12, [' = "', '="', ": ", "=", ': "', " := '"]))
    prose = F.concat(pick(13, DICTIONARY), F.lit(" "), pick(14, DICTIONARY), pick(15, [" ", ", ", ". ", " ("]))
    sums = F.concat(pick(16, ["commit ", "sha256: ", "md5=", "checksum: ", "digest sha256:", "revision ", 'etag: "', 'integrity="sha512-', "hash = ", "uuid: "]))
    digits = F.regexp_replace(h(20), "[a-f]", "7")
    forms = [
        # value, before, secret; the odd places hold wrong findings
        (F.left(h(1), pick(21, [32, 40, 64])), assign, 1),
        (F.left(h(1), pick(21, [32, 40, 64])), sums, 0),
        (F.left(b64, pick(22, [20, 32, 40, 64])), assign, 1),
        (F.left(b64, pick(22, [32, 44, 64])), sums, 0),
        (F.concat(pick(23, ["AKIA", "ghp_", "xoxb-", "sk-", "AIza", "glpat-", "npm_", "eyJ"]), F.left(b64, F.lit(32))), pick(24, ["", '"', "key: ", "use "]), 1),
        (long_words, prose, 0),
        (F.concat(pick(25, ["Tr0ub", "hunter", "P@ss", "s3cr3t!", "qW9#"]), F.left(h(2), pick(26, [4, 6, 8]))), assign, 1),
        (F.concat(pick(27, ["your_api_key_here", "xxxxxxxxxxxxxxxx", "EXAMPLEKEY123456", "changeme12345678", "<token-goes-here1>", "test_1234567890abc"]), F.left(h(2), pick(28, [1, 2]))), assign, 0),
        (F.left(h(1), F.lit(40)), assign, 1),
        (F.concat(F.lit("/"), word, F.lit("/"), pick(29, DICTIONARY), F.lit("/"), F.left(h(2), F.lit(8)), pick(30, [".html", ".js", ".png", "/index.php", ".py"])), prose, 0),
        (F.left(b64, F.lit(40)), F.concat(F.lit("Authorization: Bearer "), F.lit("")), 1),
        (F.concat_ws("-", F.substring(h(1), 1, 8), F.substring(h(1), 9, 4), F.substring(h(1), 13, 4), F.substring(h(1), 17, 4), F.substring(h(1), 21, 12)), pick(31, ["id ", "uuid: ", "session ", "trace="]), 0),
        (F.left(h(3), F.lit(40)), assign, 1),
        (F.left(digits, pick(32, [16, 19, 22])), prose, 0),
        (F.left(h(4), F.lit(32)), assign, 1),
        (F.concat(long_words, pick(33, ["2", "_v1", "-2021", ".min.js", "99"])), prose, 0),
    ]
    kind = F.pmod(i, F.lit(len(forms)))
    choose = lambda at: F.coalesce(*[F.when(kind == k, f[at] if isinstance(f[at], Column) else F.lit(f[at])) for k, f in enumerate(forms)])
    after = F.when(kind % 2 == 0, pick(34, ['"', "'", " ", ";", " and"])).otherwise(pick(35, [" ", ".", ",", '"', ") the"]))
    return spark.range(n).coalesce(1).select(choose(0).alias("value"), choose(1).alias("before"), after.alias("after"), choose(2).cast("double").alias("secret"))


def train(findings: DataFrame, trees: int = 30, depth: int = 8, seed: int = 5) -> RandomForestClassificationModel:
    forest = RandomForestClassifier(labelCol="secret", featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed)
    return forest.fit(with_features(findings))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, value, before, after) of every candidate; start counts characters from 0."""
    pattern = F.lit(CANDIDATE)
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = d.withColumn("found", F.regexp_extract_all("text", pattern, F.lit(0))).where(F.size("found") > 0)
    d = d.select("id", "found", F.split("text", CANDIDATE, -1).alias("gaps"))
    lens = F.zip_with(F.slice("gaps", 1, F.size("found")), "found", lambda g, m: (F.length(g) + F.length(m)).cast("long"))
    starts = F.zip_with(running_sums(lens), F.slice("gaps", 1, F.size("found")), lambda at, g: (at + F.length(g)).cast("int"))
    d = d.select("id", F.explode(F.arrays_zip(F.col("found"), starts.alias("starts"), F.slice("gaps", 1, F.size("found")).alias("left"), F.slice("gaps", 2, F.size("found")).alias("right"))).alias("c"))
    d = d.select("id", F.col("c.found").alias("raw"), F.col("c.starts").alias("at"), F.right(F.col("c.left"), F.lit(48)).alias("left"), F.left(F.col("c.right"), F.lit(32)).alias("after"))
    # a candidate that begins with a name: the value is what follows the assignment
    key = F.regexp_extract("raw", rf"""^[{_CHARS}]*(?i:{KEYS})["']?\s{{0,3}}(?:=|:|:=|=>)\s{{0,3}}["']?(?=[^\s"'<>]{{6,}}$)""", 0)
    value = F.regexp_replace(F.substr(F.col("raw"), F.length(key) + 1), r"[.,;:)\]}]+$", "")
    d = d.select("id", (F.col("at") + F.length(key)).alias("start"), value.alias("value"), F.concat("left", key).alias("before"), "after", (F.length(key) > 0).alias("keyed"))
    return d.where((F.col("keyed") & (F.length("value") >= 6)) | ((F.length("value") >= 16) & F.col("value").rlike("[0-9]"))).drop("keyed")


def scan(docs: DataFrame, model: RandomForestClassificationModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Candidates with the forest's ``score`` (0 to 1)."""
    judged = model.transform(with_features(candidates(docs, id_col, text_col)))
    return judged.select("id", "start", "value", "before", "after", vector_to_array("probability")[1].alias("score"))


def op1_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Every candidate of ``documents`` with its verdict; values leave only as hashes."""
    model = train(labelled_findings(spark))
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), model)
    return found.select(F.col("id").alias("doc_id"), F.col("start").cast("long").alias("start"), F.length("value").cast("long").alias("length"), F.sha2(F.col("value").cast("binary"), 256).alias("value_sha256"), "score", (F.col("score") >= 0.5).alias("is_secret"))
