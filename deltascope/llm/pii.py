"""Personal data by weak supervision.

Four kinds (email, ip, card, phone) follow fixed rules. Looser candidates
(spelled-out addresses, local phone numbers and other groups of digits, account
numbers, names beside titles or after a known first name) are decided by a model
nobody labels for: labelers that look at form, checksums, gazetteers and context
vote for, against, or not at all; expectation-maximisation over the counts of all
vote patterns estimates how reliable each labeler is, and the posteriors train a
logistic span classifier, which sees the shape of a span and the words beside it
but none of the votes. Candidates it puts at MIN_SCORE or more are spans, unless
they touch a fixed one.

Defined results: null text is the empty text; spans are in code points, end
exclusive; documents without spans have the empty text's digest and empty spans;
spans that start together are in the order of KINDS, and of looser candidates
that overlap the first and longest counts; without looser candidates nothing is
added; texts of any length are read once, whole; equal rows give equal rows; null
ids are kept; other columns, whatever their names, are left; an empty table gives
an empty result.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, written

KINDS = ["email", "ip", "card", "phone", "email_like", "phone_like", "account_like", "name_like"]
#: The kinds from here on are looser.
LOOSER = 4
MIN_SCORE = 0.8
#: Candidates that train the classifier, at most (in expectation), chosen by a hash.
SAMPLE_SPANS = 20_000

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SPELLED = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?: ?[\[({] ?(?:at|AT|@) ?[\])}] ?[A-Za-z0-9-]++(?:(?: ?[\[({] ?(?:dot|DOT|\.) ?[\])}] ?| (?:dot|DOT) |\.)[A-Za-z0-9-]++)+| (?:at|AT) [A-Za-z0-9-]++(?: (?:dot|DOT) [A-Za-z0-9-]++)+)"
)
_GROUPS = re.compile(r"(?<![A-Za-z0-9.,])\(?[0-9]++(?:[ ./()-]++[0-9]++)*(?![A-Za-z0-9])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4})+(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_CAPITALS = re.compile(r"(?<![^\W_])[A-ZÀ-ÖØ-Þ][^\W\d_]*+(?:['-][^\W\d_]++)*+(?:\.? [A-ZÀ-ÖØ-Þ][^\W\d_]*+(?:['-][^\W\d_]++)*+)+")

#: Words and forms that speak for personal data or against it.
TITLES = set("mr mrs ms miss dr prof sir madam herr frau monsieur madame mademoiselle mme mlle señor señora señorita sr sra don doña".split())
FIRST_NAMES = set(
    """james john robert michael william david richard joseph thomas charles mary patricia jennifer linda elizabeth barbara susan jessica sarah karen anna emma laura julia maria peter paul andrew daniel mark george alice
    hans klaus jürgen wolfgang stefan andreas thorsten heike sabine ursula monika petra claudia birgit jean pierre michel philippe jacques françois camille chloé élodie sophie nathalie isabelle josé juan carlos luis miguel javier
    antonio francisco carmen lucía ana isabel pilar dolores""".split()
)
DOMAINS = set("com org net edu gov mil int info biz name io co ai app dev me tv de at ch fr be es pt it nl uk ie us ca mx br ar au nz in cn jp kr ru pl cz se no dk fi eu".split())
NEAR = {
    4: re.compile(r"(?i)\b(?:e-?mail|mail|contact|write|address|reach|courriel|correo|kontakt|schreib\w*|adresse)\b"),
    5: re.compile(r"(?i)\b(?:tel|phone|call|mobile|fax|cell|telephone|dial|whatsapp|telefon|rufnummer|handy|anruf\w*|téléphone|appel\w*|portable|teléfono|llam\w*|móvil)\b"),
    6: re.compile(r"(?i)\b(?:account|iban|ssn|passport|card|bank|konto|kontonummer|compte|carte|cuenta|tarjeta|social security|ausweis|sozialversicherung\w*|dni|nif)\b"),
    7: re.compile(r"(?i)\b(?:name|named|called|dear|signed|regards|heißt|hallo|liebe|lieber|nom|nommé|appelle|cher|chère|nombre|llama|estimad\w*|querid\w*)\b"),
}
OWN = re.compile(r"(?i)\b(?:my|me|his|her|our|patient|customer|employee|mein|meine|mich|mon|ma|mes|mi|mis)\b")
ELSE = re.compile(r"(?i)(?:\b(?:page|pages|version|isbn|issn|doi|chapter|room|total|sum|price|order|invoice|item|section|line|year|born|since|until|on|in|seite|kapitel|preis|rechnung|prix|precio|capítulo|facture|total)[ :#]*$|[$€£#v]\s?$)")
UNITS = re.compile(r"(?i)^\s?(?:%|€|\$|£|kg|km|cm|mm|usd|eur|gb|mb|kb|pixels?|px|percent|meters?|miles|hours|h\b|am\b|pm\b|:[0-9])")
PLACES = set("street avenue road university institute inc ltd gmbh company hotel january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday".split())
_DATE = re.compile(r"^(?:(?:1[5-9]|20)[0-9]{2}[-./ ][0-9]{1,2}[-./ ][0-9]{1,2}|[0-9]{1,2}[-./ ][0-9]{1,2}[-./ ](?:(?:1[5-9]|20)[0-9]{2}|[0-9]{2})|(?:1[5-9]|20)[0-9]{2}(?: ?[-/] ?(?:1[5-9]|20)?[0-9]{2})?)$")
_SSN = re.compile(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$")
_LOCAL_PHONE = re.compile(r"^(?:\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}-[0-9]{4}|\(?0[0-9]{1,4}\)?[ ./-]+[0-9][0-9 .-]*[0-9]|0[1-9](?:[ .-]?[0-9]{2}){4})$")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str):
    """A match is fixed by its @: the run of local characters before it, back to the last match's end, and a domain with a dot after it."""
    done, at = 0, text.find("@")
    while at >= 0:
        # no local character is an @, so nothing before the last one is looked at again
        before = text[done:at]
        start = done + len(before.rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
        done = domain.end() if domain else at + 1
        at = text.find("@", done)


def fixed_spans(text: str) -> list[tuple[int, int, int]]:
    """start, rank of the kind, end."""
    found = [(a, 0, b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if 12 <= len(m[0]) <= 37 and 12 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            found.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(digits_of(m[0])) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def iban(text: str) -> bool:
    """The check digits of an account number."""
    t = text.replace(" ", "")
    return 15 <= len(t) <= 34 and int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1


def _words(span: str) -> list[str]:
    return re.findall(r"[^\W\d_]+", span.lower())


def votes(text: str, a: int, kind: int, b: int) -> list[int]:
    """1: personal, -1: not, 0: no opinion. Labelers: form, checksum or count of digits, gazetteer, announcing words, words of belonging, other known forms, words and units of other things."""
    span, digits, before, after = text[a:b], digits_of(text[a:b]), text[max(0, a - 40) : a], text[b : b + 12]
    form = plausible = known = 0
    other = -1 if kind in (5, 6) and (_DATE.match(span) or len(set(digits)) < 3) else 0
    if kind == 4:
        form = 1 if re.search(r"[\[({]|(?i:dot)", span) else 0
        known = 1 if _words(span)[-1] in DOMAINS else -1
    elif kind == 5:
        form = 1 if _LOCAL_PHONE.match(span) else 0
        plausible = 1 if 7 <= len(digits) <= 12 else -1
        known = 1 if digits.startswith("0") and not digits.startswith("00000") else 0
    elif kind == 6:
        is_iban = span[:2].isalpha()
        form = 1 if is_iban or _SSN.match(span) else 0
        plausible = (1 if iban(span) else -1) if is_iban else (0 if _SSN.match(span) else 1 if len(digits) <= 19 and luhn(digits) else -1)
    else:
        found = _words(span)
        form = 1 if len(found) in (2, 3) else 0
        plausible = 1 if (before.rstrip(" .").rsplit(None, 1) or [""])[-1].lower() in TITLES else 0
        known = 1 if found[0] in FIRST_NAMES else 0
        other = -1 if PLACES & set(found) else 0
    against = -1 if ELSE.search(before) or (kind in (5, 6) and UNITS.search(after)) else 0
    return [form, plausible, known, 1 if NEAR[kind].search(before) else 0, 1 if OWN.search(before) else 0, other, against]


LABELERS = 7
#: What the classifier sees: bias, kinds, counts of digits, groups and characters, separators, form, and the words beside the span, hashed.
_FORMS, _NEXT = 64, 128
_OFFSETS = {"kind": 1, "digits": 5, "groups": 27, "size": 35, "sign": 43, "form": 49, "left": 49 + _FORMS, "left2": 49 + _FORMS + _NEXT, "right": 49 + _FORMS + 2 * _NEXT}
FEATURES = 49 + _FORMS + 3 * _NEXT


def inputs(text: str, a: int, kind: int, b: int) -> list[int]:
    """The places of the classifier's inputs that are 1."""
    span = text[a:b]
    groups = [len(g) for g in re.findall(r"[0-9]+", span)]
    left, right = _words(text[max(0, a - 40) : a])[-2:], _words(text[b : b + 20])[:1]
    at = [0, _OFFSETS["kind"] + kind - LOOSER, _OFFSETS["digits"] + min(sum(groups), 21), _OFFSETS["groups"] + min(len(groups), 7), _OFFSETS["size"] + min((b - a) // 6, 7)]
    at += [_OFFSETS["sign"] + i for i, c in enumerate("()-./ ") if c in span]
    shape = re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]+", lambda m: str(len(m[0])), span))
    at.append(_OFFSETS["form"] + zlib.crc32(shape.encode()) % _FORMS)
    at += [_OFFSETS[n] + zlib.crc32(w.encode()) % _NEXT for n, w in zip(("left2", "left")[2 - len(left) :], left, strict=True)]
    return at + [_OFFSETS["right"] + zlib.crc32(w.encode()) % _NEXT for w in right]


def looser_spans(text: str) -> list[tuple[int, int, int]]:
    """start, rank, end of every candidate, by start; of overlapping ones the first and longest."""
    found = []
    if " dot " in text or " DOT " in text or any(c in text for c in "[({"):
        found += [(m.start(), 4, m.end()) for m in _SPELLED.finditer(text)]
    for m in _GROUPS.finditer(text):
        n = sum(c.isdigit() for c in m[0])
        if n >= 7:  # fewer digits name nobody
            found.append((m.start(), 6 if _SSN.match(m[0]) or n > 12 else 5, m.end()))
    found += [(m.start(), 6, m.end()) for m in _IBAN.finditer(text)]
    for m in _CAPITALS.finditer(text):
        found += _names(m)
    kept, end = [], 0
    for a, kind, b in sorted(found, key=lambda f: (f[0], -f[2], f[1])):
        if a >= end:
            kept.append((a, kind, b))
            end = b
    return kept


def _names(run: re.Match):
    """In a run of capitalised words: those after a title, and two or more of which the first is a known first name."""
    words = [(w.start() + run.start(), w.end() + run.start(), w[0].lower(), w[0].isupper() and len(w[0]) > 1) for w in re.finditer(r"[^ .]+", run[0])]
    k = 0
    while k < len(words):
        title = words[k][2] in TITLES
        if title or words[k][2] in FIRST_NAMES:
            first = last = k + title
            while last < len(words) and words[last][2] not in TITLES and not words[last][3]:
                last += 1
            if last - first >= 2 - title:
                yield words[first][0], 7, words[last - 1][1]
            k = max(last, k + 1)
        else:
            k += 1


def candidates(text: str | None) -> list[tuple]:
    """start, rank, end, votes, inputs of every fixed span (without votes and inputs), and of the looser ones that touch none of them."""
    if not text:
        return []
    fixed, looser = fixed_spans(text), looser_spans(text)
    if fixed and looser:
        starts = np.array([f[0] for f in fixed])
        reach = np.maximum.accumulate([f[2] for f in fixed])
        at = np.searchsorted(starts, [x[2] for x in looser])  # the fixed spans that start before the looser one ends
        looser = [x for x, k in zip(looser, at, strict=True) if not k or reach[k - 1] <= x[0]]
    return [(*f, [], []) for f in fixed] + [(a, kind, b, votes(text, a, kind, b), inputs(text, a, kind, b)) for a, kind, b in looser]


_SPAN = pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("end", pa.int32()), ("votes", pa.list_(pa.int32())), ("x", pa.list_(pa.int32()))])


def find_candidates(docs: DataFrame, *, doc_id="doc_id", text="text") -> DataFrame:
    """doc_id, found: an array of candidates; one row per document."""

    def run(batches):
        for batch in batches:
            rows = [[dict(zip(("start", "rank", "end", "votes", "x"), c, strict=True)) for c in candidates(t.as_py())] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(_SPAN))], ["doc_id", "found"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = T.ArrayType(T.StructType.fromDDL("start int, rank int, end int, votes array<int>, x array<int>"))
    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], T.StructField("found", found)]))


#: What EM starts from, and weighs like PRIOR_VOTES candidates a class: a vote is more likely right than wrong. By vote (-1, 0, 1).
PRIOR, PRIOR_VOTES = {0: (0.4, 0.5, 0.1), 1: (0.1, 0.5, 0.4)}, 4.0


def reliabilities(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 100) -> tuple[float, np.ndarray]:
    """EM over (votes, count): the share of personal spans, and P(vote | personal or not) as [class, labeler, vote + 1]."""
    seen = np.array([p for p, _ in patterns]) + 1
    n = np.array([c for _, c in patterns], float)
    share, chance = 0.5, np.array([[PRIOR[c]] * seen.shape[1] for c in (0, 1)])
    for _ in range(rounds):
        post = posterior(seen - 1, share, chance)
        share = float(np.clip((n * post).sum() / n.sum(), 0.01, 0.99))
        new = np.array([[PRIOR[c]] * seen.shape[1] for c in (0, 1)]) * PRIOR_VOTES
        for c, w in ((0, n * (1 - post)), (1, n * post)):
            for v in range(3):
                new[c, :, v] += ((seen == v) * w[:, None]).sum(0)
        chance = new / new.sum(2, keepdims=True)
    return share, chance


def posterior(votes: np.ndarray, share: float, chance: np.ndarray) -> np.ndarray:
    at = np.arange(votes.shape[1])
    logs = [np.log(chance[c][at, votes + 1]).sum(1) for c in (0, 1)]
    return 1 / (1 + (1 - share) / share * np.exp(logs[0] - logs[1]))


def train(found: DataFrame) -> list[float]:
    """The weights of the span classifier; empty without looser candidates."""
    spans = found.select("doc_id", F.explode("found").alias("s")).filter(F.col("s.rank") >= LOOSER)
    counts = spans.groupBy("s.votes").count().collect()  # at most 3**LABELERS patterns
    if not counts:
        return []
    share, chance = reliabilities([(tuple(r[0]), r[1]) for r in counts])
    total = sum(r[1] for r in counts)
    rate = int(min(1.0, SAMPLE_SPANS / total) * (1 << 30))
    rows = spans.filter(F.pmod(F.xxhash64("doc_id", "s.start"), F.lit(1 << 30)) < rate).select("s.votes", "s.x").collect()
    if not rows:
        return []
    x = np.zeros((len(rows), FEATURES))
    for i, r in enumerate(rows):
        x[i, r.x] = 1.0
    y = posterior(np.array([r.votes for r in rows]), share, chance)
    w = np.zeros(FEATURES)
    for _ in range(400):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= 1.0 * (x.T @ (p - y) / len(x) + 1e-4 * w)
    return [float(v) for v in w]


def op3_personal_data(spark, sf_dir):
    found = written(find_candidates(table(spark, sf_dir, "documents")), "pii")
    weights = train(found)
    names = "array({})".format(", ".join(f"'{k}'" for k in KINDS))
    vector = "cast(array({}) AS array<double>)".format(", ".join(repr(w) + "D" for w in weights))
    score = f"1 / (1 + exp(-aggregate(s.x, 0D, (a, i) -> a + {vector}[i])))" if weights else "0D"
    spans = found.select(
        "doc_id", F.expr(f"filter(found, s -> s.rank < {LOOSER})").alias("base"), F.expr(f"array_sort(filter(found, s -> s.rank < {LOOSER} OR {score} >= {MIN_SCORE}))").alias("spans")
    )
    joined = lambda s: F.expr(f"array_join(transform({s}, x -> concat_ws(':', {names}[x.rank], x.start, x.end)), ',')")
    counts = [F.expr(f"cast(size(filter(base, x -> x.rank = {k})) AS BIGINT)").alias(f"n_{KINDS[k]}") for k in range(LOOSER)]
    return spans.select("doc_id", *counts, F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))
