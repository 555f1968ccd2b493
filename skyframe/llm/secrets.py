"""Secret scans: candidate strings, and a random forest that removes false positives. DataFrame and SQL functions, and
Spark's own forest, alone.

Candidates are private key headers, signed web tokens, values assigned to names such as password, and runs of 16 or
more key characters with a digit. The forest sees a candidate's length, its character classes and the transitions
between them, how much of it dictionary words cover, its path (a document's source) and the words around it. It is
trained on labelled findings (candidate, path, before, after, label); `labelled_findings` makes `n` of them (a bound,
FINDINGS by default) from shapes of real and false findings, random by a seed.

Edge cases: null and empty texts have no candidates; a null path is an empty one; candidates that repeat are reported
at each place; rows with the same doc_id are separate rows; findings of one label alone keep all or none; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyframe.llm.common import bound, running, table, upto

FINDINGS = 6000
NAMES = r"(?:password|passwd|pwd|secret|token|api_key|apikey|api-key|access_key|auth_key|private_key|client_secret)"
KINDS = {
    "private_key": r"-----BEGIN (?:[A-Z0-9]{1,12} ){0,3}PRIVATE KEY-----",
    "web_token": r"(?<![A-Za-z0-9_.-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}(?:\.[A-Za-z0-9_-]*)?",
    "assigned": rf"(?i:(?<={NAMES}[\"']?\s{{0,2}}[:=]\s{{0,2}}[\"']?))[^\s\"'<>]{{8,}}",
    "key": r"(?<![A-Za-z0-9+/=_.-])(?=[A-Za-z_+/=-]*+[0-9])[A-Za-z0-9+/=_-]{16,}",
}
OPEN, SHUT = "\ue000", "\ue001"
DICTIONARY = "about access account action admin after alpha api app article asset author backup base best beta black blog blue book build button cache camera case change class client cloud code color com commit config content copy count country custom data date day debug default demo dev doc document download edit email error event example external feature field file final first font format from full function game green group guide hash header hello help here home host house html icon image img index info input insert internal item java json key label large last layout left level light link list local login logo long main map master media menu message meta mobile model module month name net network new news node note number object office old open option order output page param part password path photo picture plan play plugin point post price print private product profile project prod public python query read release remote report request response result review right root sample save screen screenshot script search section secret select server service session set setting shop site size small source start state static status style submit summer table tag team temp template test text that theme this time title token tool total tree type update upload url user username utils value version video view web week white widget window with word world write year your".split()
FEATURES = ["length", "transitions", "alternations", "distinct", "digits", "upper", "lower", "signs", "hex", "covered", "longest_word", "known_shape", "uuid", "number", "placeholder", "test_path", "config_path", "secret_before", "other_before", "assigned", "quoted"]


def candidates(docs: DataFrame) -> DataFrame:
    """docs (doc_id, path, text) -> doc_id, path, begins, candidate, before, after."""
    token = "|".join(f"(?:{p})" for p in KINDS.values())
    text = F.when(F.col("text").rlike(f"[{OPEN}{SHUT}]"), F.translate("text", OPEN + SHUT, "  ")).otherwise(F.col("text"))
    pieces = F.when(text.rlike("[0-9]|-----BEGIN|eyJ|(?i:" + NAMES + ")"), F.split(F.regexp_replace(text, f"({token})", f"{OPEN}$1{SHUT}"), OPEN, -1))
    df = docs.select("doc_id", F.coalesce(F.col("path").cast("string"), F.lit("")).alias("path"), pieces.alias("p")).filter(F.size("p") > 1)
    after = lambda n, x: (n + F.length(x) - F.contains(x, F.lit(SHUT)).cast("int")).cast("int")
    ends = running(F.col("p"), F.struct(F.lit(0).alias("n")), lambda s, x: (F.struct(after(s["n"], x).alias("n")), F.array(s["n"])), "int")
    part = lambda x, k: F.call_function("substring_index", x, F.lit(SHUT), F.lit(k))

    def found(z: Column) -> Column:
        own = lambda i: F.struct(F.get(z["ends"], i).alias("begins"), part(F.get(z["p"], i), 1).alias("candidate"), F.right(part(F.get(z["p"], i - 1), -1), F.lit(40)).alias("before"), F.left(part(F.get(z["p"], i), -1), F.lit(20)).alias("after"))
        return F.transform(upto(F.lit(1), F.size(z["p"])), own)

    each = bound(F.struct("p", ends.alias("ends")), found)
    return df.select("doc_id", "path", F.explode(each).alias("c")).select("doc_id", "path", "c.*")


def described(found: DataFrame) -> DataFrame:
    """found with candidate, path, before, after -> FEATURES too, all double."""
    c, low = F.col("candidate"), F.lower("candidate")
    n = F.length(c).cast("double")
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[a-z]", "a"), "[A-Z]", "B"), "[0-9]", "1"), "[^aB1]", "_")
    sound = F.regexp_replace(F.regexp_replace(low, "[aeiouy]", ""), "[a-z]", "")
    share = lambda p: F.regexp_count(c, F.lit(p)) / n
    near = F.lower(F.concat("before", F.lit(" "), "after"))
    yes = lambda x: x.cast("double")
    left = F.regexp_replace(low, "(?:" + "|".join(sorted((w for w in DICTIONARY if len(w) > 2), key=lambda w: (-len(w), w))) + ")", "")
    values = {
        "length": F.least(n, F.lit(200.0)),
        "transitions": F.regexp_count(kinds, F.lit("a(?!a|$)|B(?!B|$)|1(?!1|$)|_(?!_|$)")) / n,
        "alternations": F.regexp_count(sound, F.lit("(?=)|(?=)")) / n,
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / n,
        "digits": share("[0-9]"), "upper": share("[A-Z]"), "lower": share("[a-z]"), "signs": share("[^A-Za-z0-9]"),
        "hex": yes(low.rlike("^[0-9a-f]+$")),
        "covered": 1 - F.length(left) / n,
        "longest_word": F.coalesce(F.array_max(F.transform(F.regexp_extract_all(c, F.lit("[A-Za-z]+"), F.lit(0)), F.length)), F.lit(0)).cast("double"),
        "known_shape": yes(c.rlike(r"^(?:AKIA|ASIA)[0-9A-Z]{16}$|^gh[pousr]_[A-Za-z0-9]{20,}|^[sr]k_(?:live|test)_|^xox[abprs]-|^AIza|^eyJ|^glpat-|^npm_|PRIVATE KEY")),
        "uuid": yes(low.rlike("^[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}$")),
        "number": yes(c.rlike("^[0-9 +/=_-]+$")),
        "placeholder": yes(F.concat(low, F.lit(" "), near).rlike(r"example|placeholder|changeme|change_me|dummy|sample|your[_-]|x{5,}|0{6,}|1234567|redacted|<")),
        "test_path": yes(F.lower("path").rlike(r"test|spec|example|sample|fixture|doc|readme|mock|vendor|lock")),
        "config_path": yes(F.lower("path").rlike(r"\.env|config|settings|secret|credential|deploy|\.ya?ml|\.ini|\.tf")),
        "secret_before": yes(F.lower("before").rlike(r"(?:password|passwd|pwd|secret|token|api[_ -]?key|access[_ -]?key|auth|bearer|credential|private)\W{0,12}$")),
        "other_before": yes(F.lower("before").rlike(r"(?:commit|sha\d*|md5|checksum|digest|hash|integrity|uuid|guid|revision|etag|base64|build|version|isbn|phone|card|order|id|url|href|src|file|image)\W{0,12}$")),
        "assigned": yes(F.col("before").rlike(r"[:=]\s{0,2}[\"']?$")),
        "quoted": yes(F.col("before").rlike("[\"']$")),
    }
    return found.select("*", *[values[f].alias(f) for f in FEATURES])


def labelled_findings(spark: SparkSession, n: int = FINDINGS, seed: int = 11) -> DataFrame:
    """n labelled findings: candidate, path, before, after, label (1: a secret)."""
    i = F.col("id")
    rnd = lambda salt: F.sha2(F.concat(i.cast("string"), F.lit(f":{seed}:{salt}")), 256)
    pick = lambda salt, *xs: F.element_at(F.array(*[F.lit(x) if isinstance(x, str) else x for x in xs]), (F.pmod(F.xxhash64(i, F.lit(f"{seed}{salt}")), F.lit(len(xs))) + 1).cast("int"))
    b64 = lambda salt: F.base64(F.unhex(F.concat(rnd(salt), rnd(salt + "'"))))
    b62 = lambda salt: F.regexp_replace(b64(salt), "[^A-Za-z0-9]", "")
    word = lambda salt: pick(salt, *DICTIONARY[::3])
    num = lambda salt, k: F.substring(F.regexp_replace(F.concat(rnd(salt), rnd(salt + "'")), "[^0-9]", ""), 1, k)
    dashed = F.concat_ws("-", *[F.substring(rnd("u"), a, k) for a, k in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    ask = pick("ask", "api_key = \"", "token = \"", "secret: ", "password='", "auth token: ", "Authorization: Bearer ", "the access key ", "client_secret=\"", "credential ", "private key: ")
    bare = pick("bare", "", "some words before ", "and then ", "see ", "x ", "the ")
    code = pick("code", "src/app/main.py", "config/settings.yml", "deploy/.env", "infra/vars.tf", "src7", "lib/client.js", "", "src/server/auth.go")
    tests = pick("tests", "tests/test_app.py", "docs/readme.md", "examples/demo.py", "package-lock.json", "src7", "src/app/main.py", "")
    digest = pick("digest", "commit ", "sha256:", "checksum = ", "integrity ", "md5: ", "the hash ", "etag: \"", "revision ")
    shapes = [
        (1, F.substring(rnd("a"), 1, 40), ask, code), (1, F.substring(rnd("a"), 1, 32), ask, code), (1, F.substring(b62("a"), 1, 40), ask, code), (1, F.substring(b64("a"), 1, 64), ask, code),
        (1, F.concat(F.lit("AKIA"), F.substring(F.upper(b62("k")), 1, 16)), pick("w", ask, bare), code), (1, F.concat(F.lit("ghp_"), F.substring(b62("g"), 1, 36)), pick("w", ask, bare), code), (1, F.concat(F.lit("sk_live_"), F.substring(b62("s"), 1, 24)), pick("w", ask, bare), code),
        (1, F.concat(F.lit("eyJhbGciOi"), F.substring(b62("j"), 1, 20), F.lit(".eyJ"), F.substring(b62("l"), 1, 40)), pick("w", ask, bare), code), (1, F.lit("-----BEGIN RSA PRIVATE KEY-----"), bare, code), (1, F.concat(F.substring(b62("p"), 1, 9), pick("sig", "!", "#", "$x", "_9")), pick("pw", "password = \"", "passwd: ", "pwd='"), code),
        (0, F.substring(rnd("a"), 1, 40), digest, tests), (0, rnd("a"), digest, tests), (0, dashed, pick("i", "id: ", "uuid = \"", "", "guid "), tests), (0, num("n", 16), pick("c", "card ", "", "phone ", "order ", "isbn: ", "call "), tests), (0, num("n", 20), bare, tests),
        (0, F.concat_ws("_", word("1"), word("2"), word("3"), num("n", 2)), pick("w", bare, ask), tests), (0, F.concat_ws("-", word("1"), word("2"), word("3"), word("4"), num("n", 4)), pick("l", "url: ", "href=\"", "/", ""), tests), (0, F.concat(word("1"), F.initcap(word("2")), F.initcap(word("3")), F.initcap(word("4")), num("n", 1)), bare, tests),
        (0, F.concat(pick("ph", "your_api_key_here_", "changeme_password_", "xxxxxxxxxxxxxxxx", "example_secret_token_", "dummy-key-0000000"), num("n", 2)), ask, tests), (0, F.concat(F.lit("IMG_"), num("n", 8), F.lit("_"), num("m", 6)), pick("f", "file ", "src=\"", "image "), tests), (0, F.concat(b64("d"), b64("e")), pick("b", "data:image/png;base64,", "base64 "), tests), (0, F.concat(word("1"), F.lit("="), word("2"), num("n", 3), F.lit("/"), word("3"), word("4")), bare, tests),
    ]
    kind = F.pmod(i, F.lit(len(shapes)))
    made = F.lit(None)
    for k, (label, cand, before, path) in enumerate(shapes):
        made = F.when(kind == k, F.struct(cand.alias("candidate"), path.alias("path"), before.alias("before"), F.lit(label).alias("label"))) if k == 0 else made.when(kind == k, F.struct(cand.alias("candidate"), path.alias("path"), before.alias("before"), F.lit(label).alias("label")))
    rows = spark.range(0, n, 1, 2).select(made.alias("x"), pick("after", "\"", "", " and more words", "'\n", ",", "\" # ok").alias("after"))
    return rows.select("x.candidate", "x.path", "x.before", "after", F.col("x.label").cast("int").alias("label"))


def train(findings: DataFrame, trees: int = 30, depth: int = 9, seed: int = 5) -> RandomForestClassificationModel:
    rows = described(findings).select(array_to_vector(F.array(*FEATURES)).alias("features"), F.col("label").cast("double").alias("label"))
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(rows)


def verdicts(found: DataFrame, model: RandomForestClassificationModel, least: float = 0.5) -> DataFrame:
    """found -> the same columns, score and kept."""
    columns = found.columns
    rows = described(found).withColumn("features", array_to_vector(F.array(*FEATURES)))
    score = vector_to_array("probability")
    score = F.get(score, F.lit(1)) if model.numClasses > 1 else F.lit(0.0)
    return model.transform(rows).select(*columns, score.alias("score")).withColumn("kept", F.col("score") >= least)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("path"), "text")
    model = train(labelled_findings(spark))
    return verdicts(candidates(docs), model).select("doc_id", "begins", F.length("candidate").cast("long").alias("length"), F.sha2("candidate", 256).alias("candidate_sha256"), "score", "kept")


QUERIES = {"op6_secrets": op6_secrets}
ORACLE: dict[str, str] = {}
