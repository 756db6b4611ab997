"""Secret scans with SQL functions only.

Three kinds follow fixed patterns: assignments, access keys and hexadecimal runs.
Beyond them, runs of MIN_RUN token characters and more are compared by two
character Markov models (order 1), one of random strings and one of ordinary
tokens: the words, numbers and paths of sampled documents as they stand, and
identifiers, dates, URLs and file names made of their words. A run whose
log-likelihood ratio is at least MIN_RATIO in all and MIN_MEAN a transition is a
span of kind `random` unless it touches a fixed one.

SQL gives matches but not their offsets, so every match is set between two marks
and the text split at them: a match begins where the lengths of all pieces before
it end. Each pattern runs once over a text. Prefix sums go over chunks of CHUNK
matches, so texts of any length and with many matches stay linear.

Defined results: null text is the empty text; spans are in code points, end
exclusive; documents without spans have the empty text's digest and empty spans;
of spans of several kinds that start together the order is that of KINDS; equal
rows give equal rows; null ids are kept; other columns, whatever their names, are
left; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, written

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Shorter runs hold too few transitions to tell a random string from a code or an abbreviation.
MIN_RUN = 8
RUN = rf"[A-Za-z0-9+/_=-]{{{MIN_RUN},}}"
KINDS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "random": RUN}

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
STATES = len(ALPHABET) + 1  # 0: any other character
#: Nats in favour of "random" that a run needs, in all and on average.
MIN_RATIO, MIN_MEAN = 13.0, 1.2
#: Set around matches; in texts it becomes the other one, which no pattern knows either.
MARK, OTHER = "\x01", "\x02"
#: Labelled samples: random strings, and documents whose words make identifiers, at most.
RANDOM_SAMPLES, SAMPLE_DOCUMENTS = 6000, 500
#: Pairs of the fixed words that make identifiers, and copies of each fixed row.
NAMED_SAMPLES, ROW_SAMPLES = 40_000, 400
CHUNK = 512
#: Words that names, paths and addresses are made of, and rows of characters that people type.
NAMES = """access account admin alert android api app archive array auth backup base batch bin block body boot branch browser buffer build button byte cache card channel chart class client cloud cluster code color command
config connect console content context control cookie copy core count css custom dashboard data date debug default demo device document domain download edit element email encode engine error event export
factory feed field file filter folder font form format group handler hash header height history holiday home host html http icon image index info input int item java javascript job json key
keyboard label lang large library linux list load local lock log logo mac main map media memory menu message method min mobile model module name net node null number object order output owner package page parser path payment
photo plugin png port post price print process product profile project proxy public python query queue react readme record release remote report request response result role room route schema script search
server session setting size source sql static status style svg system table task template test text theme time token type upload url user usr util version video view web width window xml zip""".split()
TYPED = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "01234567890123456789", "9876543210", "qwertyuiopasdfghjklzxcvbnm", "00000000", "11111111", "--------------------", "====================", "____________________", "////////", "++++++++", "-=-=-=-=-=-=", "xxxxxxxxxxxx", "aaaaaaaaaaaa"]


def _in_turn(n: F.Column, forms: list) -> F.Column:
    """The form whose turn it is; only that one is made."""
    made = F.when(n % len(forms) == 0, forms[0])
    for k, form in enumerate(forms[1:], 1):
        made = made.when(n % len(forms) == k, form)
    return made


def labelled_samples(docs: DataFrame, *, doc_id="doc_id", text="text") -> DataFrame:
    """token, random: strings made from digests (base64 of several lengths, alphanumeric, base32, hexadecimal in both cases), and ordinary tokens: those of sampled documents without what the fixed patterns find, and identifiers, paths, dates and names made of neighbouring words."""
    spark = docs.sparkSession
    digest = F.sha2(F.concat(F.lit("sample:"), F.col("id").cast("string")).cast("binary"), 256)
    base64 = F.base64(F.unhex(digest))
    plain = F.regexp_replace(base64, "[+/=]", "")
    kinds = [base64, F.substring(base64, 1, 32), F.substring(digest, 1, 40), F.upper(F.substring(digest, 1, 40)), plain, F.translate(base64, "+/", "-_"), F.substring(plain, 1, 20), F.regexp_replace(F.upper(base64), "[^A-Z2-7]", ""), F.regexp_replace(F.lower(base64), "[^a-z0-9]", "")]
    made = _in_turn(F.col("id"), kinds)
    random = spark.range(RANDOM_SAMPLES).select(made.alias("token"), F.lit(True).alias("random"))
    share = int(min(1.0, SAMPLE_DOCUMENTS / max(1, docs.count())) * (1 << 30))
    sampled = docs.filter(F.pmod(F.xxhash64(doc_id, F.lit("secrets")), F.lit(1 << 30)) < share)
    body = F.coalesce(F.col(text), F.lit(""))
    for pattern in (ASSIGN, ACCESS, HEX):
        body = F.regexp_replace(body, pattern, " ")
    sampled = sampled.select(body.alias("body")).repartition(spark.sparkContext.defaultParallelism)
    own = sampled.select(F.explode(F.regexp_extract_all("body", F.lit(r"[A-Za-z0-9+/_=-]{2,}"), F.lit(0))).alias("token"))
    words = F.regexp_extract_all("body", F.lit(r"(?<![A-Za-z])[A-Za-z]{2,18}(?![A-Za-z])"), F.lit(0))
    pairs = F.expr("zip_with(words, slice(words, 2, greatest(size(words) - 1, 0)), (a, b) -> struct(lower(a) AS a, lower(coalesce(b, '')) AS b))")
    joined = sampled.select(words.alias("words")).filter("size(words) > 0").select(F.posexplode(pairs).alias("i", "p"))
    name = lambda salt: F.element_at(F.split(F.lit(" ".join(NAMES)), " "), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(NAMES))) + 1).cast("int"))
    named = spark.range(NAMED_SAMPLES).select(F.col("id").cast("int").alias("i"), F.struct(name("a").alias("a"), name("b").alias("b")).alias("p"))
    joined = joined.unionByName(named)
    n, a, b = F.pmod(F.xxhash64("i", "p"), F.lit(1_000_000)), F.col("p.a"), F.col("p.b")
    padded = lambda expr, width: F.lpad(expr.cast("string"), width, "0")
    date = F.concat_ws("-", (n % 50 + 1980).cast("string"), padded(n % 12 + 1, 2), padded(n % 28 + 1, 2))
    up = lambda w: F.initcap(w)
    styles = [
        F.concat_ws("_", a, b), F.concat(up(a), up(b)), F.concat(a, up(b)), F.concat_ws("-", a, b, (n % 100).cast("string")), F.concat_ws("/", a, b), F.upper(F.concat_ws("_", a, b)),
        F.concat_ws("/", F.lit(""), a, F.translate(date, "-", "/"), b), F.concat_ws("-", date, a, b), F.concat_ws("_", a, F.translate(date, "-", "")), F.concat_ws("-", a, padded(n, 9)),
        F.concat_ws("-", b, F.concat((n % 4000).cast("string"), F.lit("x"), (n % 3000).cast("string"))), F.concat(a, n.cast("string")), F.concat_ws("-", F.substring(F.upper(a), 1, 3), (n % 10000).cast("string")),
        F.concat(F.lit("v"), (n % 9).cast("string"), F.lit("-"), (n % 77).cast("string"), F.lit("_"), b), F.concat_ws("=", a, n.cast("string")), F.concat(F.lit("/"), a, F.lit("/"), b, F.lit("/"), up(a)), F.concat(a, up(b), up(a), (n % 100).cast("string")), F.concat_ws("-", F.substring(F.upper(b), 1, 4), (n % 1000).cast("string"), F.substring(F.upper(a), 1, 3)), F.concat(F.substring(a, 1, 2), F.lit("-"), F.substring(F.upper(b), 1, 2), F.lit("/"), up(b)), F.concat(up(a), F.substring(F.upper(b), 1, 2), F.lit("_"), n.cast("string")), F.concat(F.substring(F.upper(a), 1, 3), up(b)), F.concat(date, F.lit("T"), padded(n % 240000, 6)), F.concat(F.lit("//"), a, F.lit("/"), b, F.lit("/"), (n % 1000).cast("string")),
    ]
    made = joined.select(_in_turn(F.col("i"), styles).alias("token"))
    typed = spark.range(ROW_SAMPLES).select(F.explode(F.array(*[F.lit(t) for t in TYPED])).alias("token"))
    return random.unionByName(own.unionByName(made).unionByName(typed).withColumn("random", F.lit(False)))


def _codes(token: str) -> str:
    return f"transform(split({token}, ''), c -> instr('{ALPHABET}', c))"


def train(samples: DataFrame) -> list[float]:
    """samples(token, random) -> the log-likelihood ratio of each of the STATES * STATES transitions, random over ordinary, add-one smoothed."""
    pairs = "zip_with(codes, slice(codes, 2, greatest(size(codes) - 1, 0)), (a, b) -> a * {0} + b)".format(STATES)
    steps = samples.filter("length(token) > 1").select("random", F.expr(_codes("token")).alias("codes")).select("random", F.explode(F.expr(pairs)).alias("step"))
    counts = {True: [1.0] * STATES**2, False: [1.0] * STATES**2}
    for r in steps.filter("step IS NOT NULL").groupBy("random", "step").count().collect():  # at most 2 * STATES**2 rows
        counts[r.random][r.step] += r["count"]
    chance = {}
    for label, seen in counts.items():
        totals = [sum(seen[a * STATES : (a + 1) * STATES]) for a in range(STATES)]
        chance[label] = [n / totals[i // STATES] for i, n in enumerate(seen)]
    return [math.log(p / q) for p, q in zip(chance[True], chance[False], strict=True)]


def _spans(kind: str) -> str:
    """SQL: the spans of the matches {kind}_hits, from the lengths of the pieces around them."""
    span = "array<struct<start:int,end:int,hit:string>>"
    return f"""transform(array(filter(zip_with({kind}_gaps, {kind}_hits, (g, h) -> struct(g, length(h) AS n, h)), x -> x.h IS NOT NULL)), found ->
      transform(array(transform(sequence(0, greatest(size(found) - 1, 0) div {CHUNK}), c -> slice(found, c * {CHUNK} + 1, {CHUNK}))), chunks ->
        transform(array(aggregate(chunks, named_struct('at', 0, 'all', cast(array() AS array<int>)),
            (a, c) -> named_struct('at', aggregate(c, a.at, (s, x) -> s + x.g + x.n), 'all', concat(a.all, array(a.at))), a -> a.all)), bases ->
          flatten(transform(chunks, (c, i) -> aggregate(c, named_struct('at', bases[i], 'all', cast(array() AS {span})),
            (a, x) -> named_struct('at', a.at + x.g + x.n, 'all', concat(a.all, array(named_struct('start', a.at + x.g, 'end', a.at + x.g + x.n, 'hit', x.h)))),
            a -> a.all))))[0])[0])[0]"""


def scan(docs: DataFrame, ratios: list[float], *, doc_id="doc_id", text="text") -> DataFrame:
    """doc_id, base and spans: arrays of (start, rank, end, kind), sorted by start and then by kind."""
    body = F.replace(F.coalesce(F.col(text), F.lit("")), F.lit(MARK), F.lit(OTHER))
    marked = docs.select(F.col(doc_id).alias("doc_id"), body.alias("body")).select("doc_id", *[F.split(F.regexp_replace("body", pattern, f"{MARK}$0{MARK}"), MARK, -1).alias(kind) for kind, pattern in KINDS.items()])
    # pieces between matches and matches take turns
    turns = [(f"{kind}_hits", F.filter(kind, lambda x, i: i % 2 == 1)) for kind in KINDS] + [(f"{kind}_gaps", F.transform(F.filter(kind, lambda x, i: i % 2 == 0), lambda x: F.length(x))) for kind in KINDS]
    found = marked.select("doc_id", *[made.alias(name) for name, made in turns])
    found = written(found, "secrets")  # the patterns run once, and no later step carries a text
    table_of = ",".join(f"{x:.4f}" for x in ratios)
    ratio = f"""aggregate({_codes("x.hit")}, named_struct('before', -1, 'sum', 0D),
        (a, c) -> named_struct('before', c, 'sum', a.sum + if(a.before < 0, 0D, cast(split('{table_of}', ',') AS array<double>)[a.before * {STATES} + c])), a -> a.sum)"""
    keeps = {
        "assign": f"length(regexp_extract(x.hit, r'{{}}', 2)) >= 6".format(ASSIGN.replace("'", r"\x27")),
        "access": "true",
        "hex": "true",
        "random": f"{ratio} >= greatest({MIN_RATIO}D, {MIN_MEAN}D * (length(x.hit) - 1))",
    }
    kept = [f"transform(filter({_spans(k)}, x -> {keeps[k]}), x -> named_struct('start', x.start, 'rank', {i}, 'end', x.end, 'kind', '{k}'))" for i, k in enumerate(KINDS)]
    found = found.select("doc_id", F.expr(f"array_sort(concat({', '.join(kept[:-1])}))").alias("base"), F.expr(kept[-1]).alias("random"))
    clear = "filter(random, x -> NOT exists(base, y -> y.start < x.end AND x.start < y.end))"
    return found.select("doc_id", "base", F.expr(f"array_sort(concat(base, {clear}))").alias("spans"))


def op1_secrets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = scan(docs, train(labelled_samples(docs)))
    joined = lambda spans: f"array_join(transform({spans}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')"
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) AS BIGINT)").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(F.expr(joined("base")).cast("binary"), 256).alias("base_sha256"), F.expr(joined("spans")).alias("spans"))
