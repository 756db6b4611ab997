"""Secrets and personal data against plain regular expressions."""

import hashlib
import random
import re
import time

import pytest

from deltascope.llm import pii, secrets
from deltascope.llm.secrets import labelled_samples, scan, train

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)


def digits(text):
    return re.sub("[^0-9]", "", text)


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


SECRETS = [
    ("assign", lambda t: [m for m in ASSIGN.finditer(t) if len(m[2]) >= 6]),
    ("access", lambda t: [m for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]),
    ("hex", lambda t: [m for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]),
]
PRIVATE = [
    ("email", lambda t: list(re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t))),
    ("ip", lambda t: [m for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]),
    ("card", lambda t: [m for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]),
    ("phone", lambda t: [m for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]),
]


def base_of(kinds, text):
    found = sorted((m.start(), rank, m.end(), name) for rank, (name, find) in enumerate(kinds) for m in find(text or ""))
    return [f"{name}:{a}:{b}" for a, _, b, name in found]


def spans_of(rows, key="spans"):
    return {(r.doc_id, tuple(f"{s.kind}:{s.start}:{s.end}" for s in r[key])) for r in rows}


def test_secret_spans(spark, edge_docs, edge_rows):
    rows = scan(edge_docs, train(labelled_samples(edge_docs))).collect()
    assert len(rows) == len(edge_rows)
    assert spans_of(rows, "base") == {(i, tuple(base_of(SECRETS, t))) for i, t, *_ in edge_rows}
    assert all({tuple(s) for s in r.base} <= {tuple(s) for s in r.spans} for r in rows)


def test_many_matches_keep_their_offsets(spark):
    text = "é " + " ".join(f'token = "k{i:06d}"' for i in range(3000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = scan(docs, [0.0] * secrets.STATES**2).first()
    assert [f"{s.kind}:{s.start}:{s.end}" for s in row.base] == base_of(SECRETS, text)


#: Ordinary tokens written by hand, none of them made by the operator's own samples.
ORDINARY = """/wp-content/uploads/2019/03/holiday-photo-1024x768 articles/2024/01/15/how-to-cook-pasta 2024-01-15-2024-02-20-report order-000000000000000123 getHttpResponseCode200 MAX_BUFFER_SIZE_4096 application/json
/usr/local/lib/python3 com/example/project/Main user_profile_settings_v2 INV-2024-000123 /api/v1/users/12345/orders 20240115T120000 1234567890123 +4930123456 backup_2023_12_31 DSC00012345 IMG_20240115_134500 utf-8-sig
x86_64-linux-gnu libssl1-dev kubernetes-dashboard-7 ISO-8859-1 SHA-256-digest iPhone15ProMax covid-19-vaccine 1920x1080 HTTP/1 addEventListener XMLHttpRequest javax/servlet/http responsibilities internationalization
/2021/11/black-friday-deals-2021 page=2 utm_source=newsletter utm_campaign=spring_sale_2023 session_id=12345 /static/css/main /assets/img/logo-dark-2x README_zh_CN node_modules/react-dom/index EUR-1250-USD-1375
room-B204-floor2 Q3-2023-results 0000-00-00 123-45-6789 12/31/1999 192/168/0/1 A4-210x297mm PostgreSQL14 macOS-13-Ventura AES-256-GCM RFC-2616-section-10 ----------------- ================= _____________
test_user_login_returns_401 feature/JIRA-1234-add-login release-2024-05-rc1 /en-US/docs/Web/JavaScript ProductID_998877 ABC-12345-XYZ Windows-10-x64 abcdefghijklmnop qwertyuiop 1234567890 aaaaaaaaaaaa lasagne_recipe_final
chapter-12-section-4 annual-report-2022-final-v3 PROD_DB_HOST_01 invoice_2024_03_17 /blog/2018/07/04/summer-in-the-city minutes/2023/meeting-notes-14 student_id=0012345 screenshot-2024-02-11-at-10 UserAccountServiceImpl
renderTemplateString NullPointerException thread-pool-worker-17 track-08-disc-2 episode_s03e07 season-4-episode-12 flight-LH400-FRA-JFK highway-A7-exit-23 vitamin-B12-tablets mp3-player-16gb
gradle-wrapper-properties section-2-paragraph-15 Kapitel-3-Abschnitt-12 /de/produkte/schuhe/groesse-42 numero-de-telephone ElasticSearchClient7 SELECT_COUNT_DISTINCT en_GB-UTF-8 multipart/form-data wp-admin/admin-ajax
IMG-20231231-WA0007 report_Q4_2021_draft part-00017 base64-decoder""".split()
PROSE = "the old harbour office keeps a careful register of every vessel that entered between spring and late autumn while the clerks write down names cargo weights and captains in a long yellow ledger nobody reads today".split()


@pytest.fixture(scope="module")
def ratios(spark):
    docs = spark.createDataFrame([(i, " ".join(PROSE[i % 7 :] + PROSE[: i % 11]) + f" on 20{i % 30:02d}-0{i % 9 + 1}-11") for i in range(60)], "doc_id long, text string")
    return train(labelled_samples(docs))


def test_random_strings_are_told_from_ordinary_tokens(spark, ratios):
    """The random ones come from Python's own generator, from 12 characters up, in alphabets that secrets use."""
    rng = random.Random(20)
    letters = "abcdefghijklmnopqrstuvwxyz"
    alphabets = [letters + letters.upper() + "0123456789", letters + letters.upper() + "0123456789-_", letters + "0123456789", letters.upper() + "0123456789", letters.upper() + "234567", "0123456789abcdef", "0123456789ABCDEF"]
    secret = ["".join(rng.choice(a) for _ in range(n)) for a in alphabets for n in (12, 14, 16, 19, 22) for _ in range(12)]
    asked = spark.createDataFrame([(i, "see " + t + " there") for i, t in enumerate(secret + ORDINARY)], "doc_id long, text string")
    found = {r.doc_id: [(s.start, s.end, s.kind) for s in r.spans] for r in scan(asked, ratios).collect()}
    hits = sum(found[i] == [(4, 4 + len(t), "random")] for i, t in enumerate(secret))
    wrong = [t for i, t in enumerate(ORDINARY) if found[len(secret) + i]]
    assert hits >= 0.9 * len(secret)
    assert len(ORDINARY) >= 100 and len(wrong) <= 0.01 * len(ORDINARY), wrong


def test_the_query_equals_plain_expressions(spark, edge_docs, edge_rows, tmp_path):
    """op1_secrets itself: counts, digest and spans; the model's spans by the ratio of each run, computed in Python."""
    edge_docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    ratios = train(labelled_samples(edge_docs))
    place = {c: i + 1 for i, c in enumerate(secrets.ALPHABET)}

    def random_runs(text, base):
        for m in re.finditer(r"[A-Za-z0-9+/_=-]{8,}", text):
            codes = [place[c] for c in m[0]]
            ratio = sum(round(ratios[a * secrets.STATES + b], 4) for a, b in zip(codes, codes[1:]))
            if ratio >= max(secrets.MIN_RATIO, secrets.MIN_MEAN * (len(codes) - 1)) and not any(a < m.end() and m.start() < b for a, b in base):
                yield m.start(), 3, m.end(), "random"

    want = []
    for i, text, *_ in edge_rows:
        base = base_of(SECRETS, text)
        fixed = [tuple(map(int, s.split(":")[1:])) for s in base]
        ranks = {name: k for k, (name, _) in enumerate(SECRETS)}
        spans = sorted([(a, ranks[s.split(":")[0]], b, s.split(":")[0]) for s, (a, b) in zip(base, fixed)] + list(random_runs(text or "", fixed)))
        n = [sum(s.startswith(k + ":") for s in base) for k in ("assign", "access", "hex")]
        want.append((i, *n, hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)))
    got = secrets.op1_secrets(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_no_documents(spark, no_docs):
    assert scan(no_docs, train(labelled_samples(no_docs))).collect() == []
    assert pii.find_candidates(no_docs).collect() == [] and pii.train(pii.find_candidates(no_docs)) == []


def test_personal_spans(spark, edge_docs, edge_rows):
    rows = pii.find_candidates(edge_docs).collect()
    fixed = {(r.doc_id, tuple(f"{pii.KINDS[s.rank]}:{s.start}:{s.end}" for s in r.found if s.rank < 4)) for r in rows}
    assert len(rows) == len(edge_rows) and fixed == {(i, tuple(base_of(PRIVATE, t))) for i, t, *_ in edge_rows}


@pytest.mark.parametrize("text", ["a@b.c.d@e.f x@y", "a@b@c.de", "..@x.y", "@a.b", "1.2.3.4.5.6.7.8", "256.1.1.1 1.2.3.004", "4111 1111 1111 1111 0", "4111-1111-1111-1111", "+1+22 333 444 555", "+1 2", "é+49 (0)30 1234567-", "+12" + " " * 500 + "3456789"])
def test_fixed_rules(text):
    found = [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in pii.fixed_spans(text)]
    assert found == base_of(PRIVATE, text)


def test_long_runs_take_linear_time():
    assert pii.fixed_spans("a" * 200_000 + "@" * 1000 + "1" * 200_000 + "." * 1000) == []


def test_reliable_labelers_are_told_from_noise():
    """Planted: labelers 0 to 3 are right in 95, 85, 75 and 65 % of the cases, 4 is noise, 5 is always right but votes on a tenth."""
    rng = random.Random(6)
    rates, counts = [0.95, 0.85, 0.75, 0.65, 0.5], {}
    for _ in range(4000):
        truth = rng.random() < 0.3
        votes = tuple((1 if (rng.random() < r) == truth else -1) for r in rates) + (((1 if truth else -1) if rng.random() < 0.1 else 0),)
        counts[votes] = counts.get(votes, 0) + 1
    share, chance = pii.reliabilities(list(counts.items()))
    right = [(chance[1, k, 2] + chance[0, k, 0]) / 2 for k in range(5)]
    assert abs(share - 0.3) < 0.03
    assert all(abs(r - w) < 0.05 for r, w in zip(right, rates)), right
    assert right == sorted(right, reverse=True) and chance[1, 5, 2] > 5 * chance[0, 5, 2]


def planted_texts():
    """text, the looser spans in it that are personal."""
    rng = random.Random(8)
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: rng.choice(PROSE)
    names = ["Mary Poole", "Hans Gruber", "Claudia Vogel", "James Whitfield", "Isabel Serrano"]
    for i in range(240):
        before, after = " ".join(word() for _ in range(6)), " ".join(word() for _ in range(6))
        mail = f"{word()}{i} [at] {word()}-shop [dot] {rng.choice(['com', 'de', 'org'])}"
        phone = f"{rng.randint(200, 999)}-{d(3)}-{d(4)}"
        ssn = f"{d(3)}-{d(2)}-{d(4)}"
        name = rng.choice(names)
        yield f"{before}, write to {mail} {after}", [("email_like", mail)]
        yield f"{before}, call my office at {phone} {after}", [("phone_like", phone)]
        yield f"{before}, his ssn {ssn} {after}", [("account_like", ssn)]
        yield f"{before}, signed by Dr. {name} {after}", [("name_like", name)]
        yield f"{before} on {rng.randint(1980, 2024)}-{rng.randint(10, 12)}-{rng.randint(10, 28)} {after}", []
        yield f"{before} version 10.{d(4)}.{d(4)} and item {d(4)}-{d(4)} {after} page 1234567", []
        yield f"{before} total: {d(4)} {d(4)} kg {after}", []


def test_planted_looser_spans_are_found_and_dates_are_not(spark, tmp_path):
    planted = list(planted_texts())
    frame = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(planted)], "doc_id long, text string")
    frame.coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in pii.op3_personal_data(spark, str(tmp_path)).collect()}
    assert len(found) == len(planted) and all(r.n_email == r.n_ip == r.n_phone == 0 for r in found.values())
    hits, misses, wrong = {}, {}, 0
    for i, (text, spans) in enumerate(planted):
        got = {(k, text[int(a) : int(b)]) for k, a, b in (s.split(":") for s in found[i].spans.split(",") if s)}
        for kind, span in spans:
            (hits if (kind, span) in got else misses).setdefault(kind, []).append(span)
        wrong += not spans and bool(got)
    assert all(len(hits.get(k, [])) >= 0.9 * 240 for k in pii.KINDS[pii.LOOSER :]), {k: len(v) for k, v in hits.items()}
    assert wrong <= 0.01 * 720


def test_the_personal_query_keeps_the_base(spark, edge_docs, edge_rows, tmp_path):
    """op3_personal_data itself: counts and digest against plain expressions; the fixed spans among all."""
    edge_docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = pii.op3_personal_data(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    want = []
    for i, text, *_ in edge_rows:
        base = base_of(PRIVATE, text)
        want.append((i, *[sum(s.startswith(k + ":") for s in base) for k in ("email", "ip", "card", "phone")], hashlib.sha256(",".join(base).encode()).hexdigest(), tuple(base)))
    rows = [(*tuple(r)[:6], tuple(s for s in r.spans.split(",") if s.split(":")[0] in pii.KINDS[: pii.LOOSER])) for r in got.collect()]
    assert sorted(map(str, rows)) == sorted(map(str, want))


@pytest.mark.parametrize("text", ["1 " * 100_000 + "x", "9" * 200_000, "a" * 200_000 + " [at", "A " * 100_000, "AB12" * 50_000, " at b" * 50_000 + " dot ", "(1-" * 50_000, "Dr. " * 50_000])
def test_looser_patterns_take_linear_time(text):
    began = time.process_time()
    pii.candidates(text)
    assert time.process_time() - began < 5


def test_account_numbers():
    assert pii.iban("GB82 WEST 1234 5698 7654 32") and not pii.iban("GB83 WEST 1234 5698 7654 32") and not pii.iban("GB82")
