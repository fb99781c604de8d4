"""Secrets in texts: candidates by pattern, false positives removed by a random forest (operator 6).

Everything on the way is DataFrame functions: candidates are long runs of key characters; the features are length,
character transitions, coverage by a dictionary of the corpus's own frequent words, path marks and what labelled
findings tell about the neighbouring words; Spark's random forest is trained on labelled findings and keeps what it
takes for a secret.

No public table of labelled findings is at hand, so ``labelled_findings`` writes a fixed number of them: every kind of
value alone, behind names of every sort and in the places that configuration, code, lock files, logs and prose have for
them. What a random value is, its place says. Random parts come from hashes of the row number, so they are the same for
every corpus; only filler words are the corpus's.

Defined results: null and empty texts have no candidates; every run of a word is one, however long the text; repeated
words and rows give a row each; a null doc_id is passed through; an empty table has no findings; extra columns of any
name are ignored, or kept by ``redacted``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, words_column

#: Characters of a candidate, and the fewest it has.
RUN = r"[A-Za-z0-9_+/=.\-]{16,}"
#: Labelled findings of one fit, and trees and depth of the forest.
LABELLED, TREES, DEPTH, SEED, ACCEPT = 13000, 24, 8, 17, 0.5
#: A dictionary word makes up this share of all words of the corpus, so there are 1 / DICTIONARY_SHARE words at most.
DICTIONARY_SHARE, WORD_LETTERS = 1 / 5000, (3, 12)
#: Standard deviations from the usual rate of secrets that it takes for a neighbouring word to tell anything.
NEIGHBOUR_DEVIATIONS = 2.5

FEATURES = [
    "length", "digits", "lowers", "uppers", "others", "hex_share", "transitions", "distinct_share",
    "dictionary", "path_marks", "user_info", "dots", "dashes", "neighbour_high", "neighbour_low", "assigned", "quoted",
]

# Parts of names of what must stay secret, and of what need not.
SECRET_PARTS = (
    "token secret password passwd pwd passphrase api_key apikey auth private_key access_key secret_key signing_key "
    "encryption_key master_key session_key client_secret webhook_secret credential credentials bearer hmac pat "
    "auth_token access_token refresh_token deploy_key"
).split()
OPEN_PARTS = (
    "commit sha sha1 sha256 md5 digest checksum hash etag revision integrity fingerprint public_key pubkey uuid guid id "
    "request_id trace_id span_id build version order invoice phone card account isbn serial url path file module class "
    "author date ref parent tree blob object icon image thumbnail certificate nonce cursor snapshot layer"
).split()
# Words that stand before either, and where else keys and other random texts stand; # is the value, ~ a word.
OWNERS = "app prod staging user admin mail payment cloud storage queue search metrics build service internal main legacy db".split()
SECRET_PLACES = [
    "postgres://~:#@~.example.com/~", "mysql://~:#@db.example.com", "redis://:#@~.example.com:6379", "https://~:#@git.example.com/~",
    "amqp://~:#@~.example.com", "Authorization: Bearer #", "Authorization: Basic #", "X-Api-Key: #", "x-auth-token: #", "curl -u ~:# https://~.example.com",
    "--password #", "--token=#", "https://~.example.com/~?access_token=#", "login ~ password #", "https://~.example.com/hook?secret=#", "sign with hmac key #",
]
OPEN_PLACES = [
    'integrity="sha512-#"', 'integrity="sha384-#"', "sha256-#", "image@sha256:#", "ssh-rsa #", "ssh-ed25519 #", "data:image/png;base64,#",
    'src="data:font/woff2;base64,#"', "~.example.com/~ v1.4.0 h1:#", "~ v0.3.1/go.mod h1:#", "https://docs.example.com/document/d/#/edit",
    "https://files.example.com/d/#", "https://~.example.com/~/#/view", "Fingerprint SHA256:#", "merge commit #", "git checkout #", "If-None-Match: #",
    "-----BEGIN CERTIFICATE----- #", "-----BEGIN PUBLIC KEY----- #", "https://~.example.com/watch?v=#", "resolved https://~.example.com/~/-/~.tgz##",
]


@dataclass
class Model:
    """The forest, the corpus's frequent words, and the weights of neighbouring words."""

    forest: RandomForestClassificationModel
    words: list[str]
    neighbours: dict[str, float]


def dictionary(docs: DataFrame) -> list[str]:
    """Lower-case words that make up DICTIONARY_SHARE of all words of ``docs`` each, most frequent first."""
    letters = F.split(F.lower(F.col("text")), r"[^\p{L}]+")
    counts = docs.filter("text is not null").select(F.explode(letters).alias("word")).filter("word <> ''")
    counts = Scratch(docs.sparkSession, "op6").table("counts", counts.groupBy("word").agg(F.count("*").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    frequent = counts.filter((F.col("n") >= total * DICTIONARY_SHARE) & F.length("word").between(*WORD_LETTERS))
    return [r.word for r in frequent.orderBy(F.desc("n"), "word").collect()]  # 1 / DICTIONARY_SHARE words at most


def _hits(text: Column | str, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def candidates(docs: DataFrame) -> DataFrame:
    """One row per candidate of ``docs`` (doc_id, text): doc_id, word_index, finding, before, word, lead, after.

    ``word`` is the run with what lies between it and the runs beside it, ``lead`` the part before it; where that part
    has no letter, the run before may be a name (``"long_private_name":"..."``) and is put in front.
    """
    found = F.filter(
        F.transform(
            F.col("words"),
            lambda w, i: F.struct(
                i.alias("word_index"), w.alias("word"), F.regexp_extract_all(w, F.lit(RUN), F.lit(0)).alias("runs")
            ),
        ),
        lambda c: F.size(c["runs"]) > 0,
    )
    runs = F.col("w.runs")

    def pieces(gaps: Column) -> Column:
        def piece(r: Column, k: Column) -> Column:
            gap = F.get(gaps, k)
            named = (k > 0) & ~gap.rlike(r"\p{L}")
            return F.struct(
                F.col("w.word_index").alias("word_index"),
                r.alias("finding"),
                F.concat(gap, r, F.get(gaps, k + 1)).alias("word"),
                F.when(named, F.concat(F.get(runs, k - 1), gap)).otherwise(gap).alias("lead"),
            )

        return F.transform(runs, piece)

    docs = docs.filter(F.col("text").rlike(RUN)).select("doc_id", words_column("text").alias("words"))
    rows = docs.select("doc_id", "words", F.explode(found).alias("w"))
    # a word is split once, however many runs it has
    split = F.transform(F.array(F.split("w.word", RUN, -1)), pieces)
    rows = rows.select("doc_id", "words", F.explode(F.flatten(split)).alias("c"))
    at = F.col("c.word_index")
    near = lambda d: F.coalesce(F.get("words", at + d), F.lit(""))
    return rows.select(
        "doc_id", "c.word_index", "c.finding", "c.word", "c.lead",
        F.concat_ws(" ", near(-3), near(-2), near(-1)).alias("before"), near(1).alias("after"),
    )


def _with_names(found: DataFrame) -> DataFrame:
    """``found`` with its neighbouring words in lower case (``names``) and with the text right before it in ``lead``,
    where a run may begin with its own name, as in token=..., sha512-..., ghp_... and AKIA..."""
    own = r"^(?:[A-Z]{4}(?=[A-Z0-9]{16}$)|[A-Za-z0-9_.\-]+=(?=[^=])|(?:[A-Za-z]{2,8}[0-9]{0,3}[-_]){1,2}(?=[A-Za-z0-9+/=]{16}))"
    lead = F.concat("lead", F.regexp_extract("finding", own, 0))
    parts = F.regexp_replace(F.concat_ws(" ", "before", lead, "after"), "([a-z])([A-Z])", "$1 $2")
    return found.withColumn("names", F.split(F.lower(parts), r"[^a-z0-9]+")).withColumn("lead", lead)


def with_features(found: DataFrame, words: list[str], neighbours: dict[str, float]) -> DataFrame:
    """``candidates`` with the columns of FEATURES."""
    s, length = F.col("finding"), F.length("finding").cast("double")
    digits, lowers, uppers = (_hits(s, p) for p in ("[0-9]", "[a-z]", "[A-Z]"))
    changes = _hits(s, "(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])")
    known = "|".join(sorted(words, key=lambda w: (-len(w), w)))  # letters only; longer words are taken first
    plain = F.length(F.regexp_replace(F.lower(s), known, "")).cast("double") if known else length
    flag = lambda c: c.cast("double")
    pairs = [x for w, v in sorted(neighbours.items()) for x in (F.lit(w), F.lit(v))]
    weights = F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,double>")
    told = F.transform("names", lambda w: F.coalesce(F.try_element_at(weights, w), F.lit(0.0)))
    return _with_names(found).select(
        "*",
        length.alias("length"),
        (digits / length).alias("digits"),
        (lowers / length).alias("lowers"),
        (uppers / length).alias("uppers"),
        ((length - digits - lowers - uppers) / length).alias("others"),
        (_hits(s, "[0-9a-fA-F]") / length).alias("hex_share"),
        (changes / length).alias("transitions"),
        (F.size(F.array_distinct(F.split(s, ""))) / length).alias("distinct_share"),
        (1 - plain / length).alias("dictionary"),
        _hits("word", r"[/\\]|://").alias("path_marks"),
        flag(F.col("word").rlike("://[^/@]*:[^/@]+@")).alias("user_info"),
        _hits(s, r"[.]").alias("dots"),
        _hits(s, r"[-_]").alias("dashes"),
        F.coalesce(F.array_max(told), F.lit(0.0)).alias("neighbour_high"),
        F.coalesce(F.array_min(told), F.lit(0.0)).alias("neighbour_low"),
        flag(F.concat(F.substring_index("before", " ", -1), "lead").rlike("[=:]")).alias("assigned"),
        flag(F.col("word").rlike("[\"'`]")).alias("quoted"),
    )


def _random(n: int, size: int, digits: str = "0123456789abcdef") -> Column:
    """``size`` characters that depend on the row and ``n`` alone; of 16 digits, or of base 64."""
    salted = lambda k: F.sha2(F.concat_ws("/", F.col("doc_id"), F.lit(n), F.lit(k)), 512)
    if digits == "base64":
        made = F.base64(F.unhex(F.concat(salted(0), salted(1))))
        return F.substring(F.translate(made, "\r\n=", ""), 1, size)
    return F.substring(F.translate(F.concat(salted(0), salted(1)), "0123456789abcdef", digits), 1, size)


def _pick(n: int, options: list[str]) -> Column:
    """One of ``options``, chosen by the row and ``n``."""
    listed = F.split(F.lit("\n".join(options)), "\n")  # one literal, however many there are
    return F.get(listed, F.pmod(F.xxhash64("doc_id", F.lit(n)), F.lit(len(options))).cast("int"))


def labelled_findings(spark: SparkSession, words: list[str]) -> DataFrame:
    """(doc_id, text, label, kind, place): LABELLED findings among ``words``, secrets (1) and what scanners take for them (0).

    Every kind of value comes in every place: alone, behind a name, and in places of either sort. Names are put together
    from an owner and a part, in several spellings. Random values are secrets behind names that no part of shows to be
    open, names never heard of included, and in places of secrets; alone, behind open names and in open places they are
    none. Keys that their own form tells are secrets anywhere; numbers, words, paths, placeholders and rules nowhere."""
    words = words or ["and", "the", "one"]
    short = [w for w in words if w.isascii()] or words
    joined = lambda n, k, sep="": F.concat_ws(sep, *[_pick(n + i, short) for i in range(k)])
    numbers = "0123456789012345"
    alnum = F.regexp_replace(_random(1, 80, "base64"), "[+/]", "")
    uuid = F.concat_ws("-", *[_random(20 + n, n) for n in (8, 4, 4, 4)], _random(30, 12))
    jwt = F.concat(F.lit("eyJ"), _random(2, 33, "base64"), F.lit(".eyJ"), _random(3, 61, "base64"), F.lit("."), _random(4, 43, "base64"))
    # kind: (value, what it is: a secret, nothing, or what its place says)
    values = {
        "short hex": (F.substr(_random(5, 28), F.lit(1), F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(13)).cast("int") + 16), None),
        "hex32": (_random(13, 32), None),
        "hex40": (_random(6, 40), None),
        "hex64": (_random(7, 64), None),
        "base64 key": (_random(8, 40, "base64"), None),
        "password": (F.substring(alnum, 1, 22), None),
        "long key": (_random(9, 60, "base64"), None),
        "cloud key id": (F.concat(F.lit("AKIA"), F.upper(F.substring(alnum, 1, 16))), 1),
        "prefixed key": (F.concat(_pick(10, ["ghp_", "sk_live_", "xoxb-", "hf_", "npm_", "glpat-"]), F.substring(alnum, 1, 36)), 1),
        "web token": (jwt, 1),
        "uuid": (uuid, 0),
        "number16": (_random(11, 16, numbers), 0),
        "number20": (_random(12, 20, numbers), 0),
        "dotted number": (F.concat_ws(".", *[_random(60 + n, n, numbers) for n in (4, 2, 3, 6)]), 0),
        "words": (joined(100, 5), 0),
        "capital words": (F.initcap(joined(110, 5)), 0),
        "end of line": (F.concat(joined(115, 5), F.lit(".")), 0),
        "snake words": (joined(120, 4, "_"), 0),
        "camel words": (F.concat(_pick(125, short), *[F.initcap(_pick(126 + i, short)) for i in range(4)]), 0),
        "dashed words": (joined(130, 4, "-"), 0),
        "path": (F.concat(F.lit("/"), joined(140, 4, "/"), _pick(145, [".txt", ".py", "/", "", ".json"])), 0),
        "module": (joined(150, 4, "."), 0),
        "address": (F.concat(_pick(155, ["https://www.", "http://", "https://cdn."]), joined(156, 2), F.lit(".example.com/"), joined(158, 2, "/")), 0),
        "mail": (F.concat(_pick(160, short), F.lit("@"), _pick(161, ["mail", "post", "mx"]), _random(162, 1, numbers), F.lit(".example.com")), 0),
        "placeholder": (F.concat(_pick(165, ["your_", "my-", "insert_", "example_"]), joined(166, 2, "_"), _pick(168, ["_here", "_token_here", "-key"])), 0),
        "rule": (F.repeat(_pick(170, ["=", "-", ".", "x", "_", "0", "X"]), 24), 0),
    }
    kinds, k, sort = list(values), F.col("k"), F.col("sort")
    chosen = lambda of: reduce(lambda done, i: F.when(k == i, of(values[kinds[i]])).otherwise(done), range(len(kinds)), F.lit(None))
    draw = lambda n, many: F.pmod(F.xxhash64("doc_id", F.lit(n)), F.lit(many)).cast("int")
    # random values, which their place decides on, are half of all
    half = F.when(draw(87, 2) == 0, draw(86, 7)).otherwise((F.col("id") % len(kinds)).cast("int"))
    rows = spark.range(LABELLED).withColumn("doc_id", F.col("id")).select("doc_id", half.alias("k"))
    # 0: alone, 1: an open name, 2: a name of secrets, 3: a name never heard of, 4: an open place, 5: a place of secrets
    rows = rows.select("*", F.get(F.array(*map(F.lit, (0, 1, 1, 2, 2, 3, 4, 4, 4, 5, 5))), draw(90, 11)).alias("sort"))
    rows = rows.withColumn("sort", F.when((sort == 4) & k.between(7, 9), 0).otherwise(sort))  # where keys of such forms never stand
    part = F.when(sort == 2, _pick(91, SECRET_PARTS)).when(sort == 1, _pick(92, OPEN_PARTS)).otherwise(_pick(93, short))
    owner = F.when(sort == 3, _pick(83, short)).otherwise(_pick(84, OWNERS))
    name = F.when((sort < 3) & (draw(85, 3) == 0), part).otherwise(F.concat_ws("_", owner, part))
    camel = F.concat(F.substring(name, 1, 1), F.substring(F.replace(F.initcap(F.translate(name, "_", " ")), F.lit(" "), F.lit("")), 2, 99))
    name = F.when(draw(82, 4) == 0, F.upper(name)).when(draw(82, 4) == 1, camel).when(draw(82, 4) == 2, F.translate(name, "_", "-")).otherwise(name)
    place = F.when(sort == 4, _pick(80, OPEN_PLACES)).otherwise(_pick(81, SECRET_PLACES))
    told = F.when(sort.isin(2, 3, 5), 1).otherwise(0)
    rows = rows.select(
        "doc_id", "k", "sort", name.alias("name"), place.alias("place"), chosen(lambda v: v[0]).alias("v"),
        F.coalesce(chosen(lambda v: F.lit(v[1]).cast("int")), told).alias("label"),
    )
    tables = Scratch(spark, "op6")  # written, so that Catalyst writes no expression out more than once
    rows = tables.table("values", rows)
    styles = ['%s = "%s"', "%s: %s", "%s=%s", '"%s":"%s"', "%s %s", "%s: '%s'", "%s = %s", '%s: "%s"', "%s = '%s'"]
    bare = F.when(draw(95, 2) == 0, F.col("v")).otherwise(F.format_string('"%s"', "v"))
    named = reduce(lambda done, i: F.when(draw(94, len(styles)) == i, F.format_string(styles[i], "name", "v")).otherwise(done), range(len(styles)), F.lit(None))
    placed = F.replace(F.replace("place", F.lit("~"), _pick(79, short)), F.lit("#"), F.col("v"))
    middle = F.when(sort == 0, bare).when(sort < 4, named).otherwise(placed)
    text = F.concat_ws(" ", _pick(96, short), _pick(97, short), middle, _pick(98, short), _pick(99, short))
    rows = rows.select("doc_id", "label", "k", "sort", "name", "place", text.alias("text"))
    # whole texts in capitals: hex and what is no key; base 64 would be another key then
    shouted = (draw(89, 10) == 0) & ((k <= 3) | (k >= 10)) & (sort < 4)
    kind = F.get(F.split(F.lit("\n".join(kinds)), "\n"), k).alias("kind")
    text = F.when(shouted, F.upper("text")).otherwise(F.col("text")).alias("text")
    where = F.when(sort == 0, "alone").when(sort < 4, F.lower("name")).otherwise(F.col("place")).alias("place")
    return tables.table("findings", rows.select("doc_id", text, "label", kind, where))


def _assembled(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)


def _target(labelled: DataFrame) -> DataFrame:
    """The longest candidate of each labelled text, with its label and kind."""
    best = candidates(labelled).groupBy("doc_id").agg(F.max_by(F.struct("*"), F.struct(F.length("finding"), "finding")).alias("c"))
    return best.select("c.*").join(labelled.select("doc_id", "label", "kind"), "doc_id")


def _weights(rows: DataFrame) -> DataFrame:
    """(name, weight): what a neighbouring word adds to the log-odds of a secret, by one regularised Newton step from
    the rate of secrets among findings with the same kinds of characters. Words beside forms that are always or never
    secrets add nothing; those whose findings are as often secrets as others are left out."""
    kinds = ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]", "^[0-9a-fA-F]+$")
    form = F.concat(*[F.col("finding").rlike(p).cast("int").cast("string") for p in kinds])
    rows = rows.withColumn("form", form)
    rates = rows.groupBy("form").agg(F.avg("label").alias("p"))
    beside = _with_names(rows).select("form", "label", F.explode(F.array_distinct("names")).alias("name")).filter("name <> ''")
    gain, spread = F.sum(F.col("label") - F.col("p")), F.sum(F.col("p") * (1 - F.col("p")))
    told = beside.join(F.broadcast(rates), "form").groupBy("name").agg(gain.alias("g"), spread.alias("s"))  # a row a form
    return told.filter(F.abs("g") > NEIGHBOUR_DEVIATIONS * F.sqrt("s")).select("name", F.round(F.col("g") / (F.col("s") + 2), 2).alias("weight"))


def fit(labelled: DataFrame, words: list[str]) -> Model | None:
    """A model from labelled findings (doc_id, text, label, kind), a bounded table; None without both labels."""
    tables = Scratch(labelled.sparkSession, "op6")
    rows = tables.table("labelled", _target(labelled))
    if rows.agg(F.count_distinct("label")).first()[0] < 2:
        return None
    neighbours = {r.name: r.weight for r in _weights(rows).collect()}  # of at most LABELLED findings
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, labelCol="label", featuresCol="features")
    # in one order and one partition (LABELLED rows), so that the forest is the same on every cluster
    features = with_features(rows, words, neighbours).select("doc_id", "label", *FEATURES)
    features = tables.table("features", features.coalesce(1).sortWithinPartitions("doc_id"))
    return Model(forest.fit(_assembled(features)), words, neighbours)


def fitted(docs: DataFrame) -> Model | None:
    """A model for ``docs``: its dictionary from all of them, the forest from labelled findings."""
    words = dictionary(docs)
    return fit(labelled_findings(docs.sparkSession, words), words)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, word_index, finding, score) of every candidate."""
    rows = model.forest.transform(_assembled(with_features(candidates(docs), model.words, model.neighbours)))
    return rows.select("doc_id", "word_index", "finding", vector_to_array("probability")[1].alias("score"))


def findings(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, word_index, finding, score) of candidates that the forest takes for secrets; without a model every
    candidate stays, with a null score."""
    if model is None:
        return candidates(docs).select("doc_id", "word_index", "finding", F.lit(None).cast("double").alias("score"))
    return scored(docs, model).filter(F.col("score") >= ACCEPT)


def redacted(docs: DataFrame, model: Model | None, mark: str = "<secret>") -> DataFrame:
    """``docs`` with every accepted finding replaced in the text, and n_chars, if there, set to the new length."""
    key = lambda t: F.xxhash64(F.col(f"{t}.doc_id"), F.col(f"{t}.text"))
    rows = docs.alias("d")
    found = findings(rows.select(key("d").alias("doc_id"), "text"), model)
    found = found.groupBy("doc_id").agg(F.collect_set("finding").alias("found")).alias("f")  # of one text
    runs = F.regexp_extract_all("d.text", F.lit(RUN), F.lit(0))
    gaps = F.split("d.text", RUN, -1)
    put = lambda gap, run: F.concat(gap, F.when(F.array_contains("f.found", run), F.lit(mark)).otherwise(F.coalesce(run, F.lit(""))))
    clean = F.array_join(F.zip_with(gaps, runs, put), "")
    has = F.col("f.found").isNotNull()
    kept = [F.col(f"d.`{c}`").alias(c) for c in docs.columns]
    out = rows.join(found, key("d") == F.col("f.doc_id"), "left")
    text = F.when(has, clean).otherwise(F.col("d.text"))
    for i, c in enumerate(docs.columns):
        if c == "text":
            kept[i] = text.alias(c)
        elif c == "n_chars":
            kept[i] = F.when(has, F.length(clean).cast(docs.schema[c].dataType)).otherwise(F.col("d.n_chars")).alias(c)
    return out.select(*kept)
