import hashlib
import random
import re

from pyspark.sql import functions as F

from millrace.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def brute(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, kind, m.end()))
    return sorted(out)


def texts_of(seed, n):
    rng = random.Random(seed)
    parts = ["a.b@c.de", "x@y", "@", ".", "_", "é", "👍", " ", "-", "+", "(", "1", "4111 1111 1111 1111", "4111-1111-1111-1111", "5500005555555559", "+1 (555) 010-9999", "10.0.0.1", "256.1.1.1", "00255.1.2.3", "7", "0.", "\n", "mail", "a@b.c_d@e.f"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(n)]
    return [None, "", "a" * 4000, "1" * 4000, "1." * 2000, "a." * 2000 + "@", "a@" * 2000, "a@b.c " * 3000, *texts]


def test_base_spans_match_python(spark):
    texts = texts_of(3, 800)
    got = pii.op4_pii(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(got) == len(texts)
    for r in got:
        want = brute(texts[r.doc_id])
        joined = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), (texts[r.doc_id] or "")[:200]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for _, j, _, _ in want) for k in range(4)]
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))


def test_added_kinds_and_context(spark):
    texts = ["IBAN GB82 WEST 1234 5698 7654 32 ok", "GB82 WEST 1234 5698 7654 33", "my ssn: 123-45-6789", "part 123-45-6789", 'token = "beb071129071368dda607a748490d0e86b5901a8"', "commit beb071129071368dda607a748490d0e86b5901a8", "password=4000dade4a62e3c1d6"]
    spans = [r.spans for r in pii.op4_pii(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).sort("doc_id").collect()]
    assert spans == ["iban:5:32", "", "ssn:8:19", "", "secret:9:49", "", "secret:9:27"]
    out = pii.masked(spark.createDataFrame([("me a@b.cd, é 10.0.0.1!",), (None,)], "text string")).collect()
    assert [r.text for r in out] == ["me [email], é [ip]!", None]


def test_edges_and_running_sums(spark):
    assert pii.op4_pii(spark, spark.createDataFrame([], "doc_id long, text string, spans int")).count() == 0
    odd = spark.createDataFrame([(None, "a@b.cd", 1), (None, "a@b.cd", 1)], "doc_id long, text string, spans int")
    assert [r.n_email for r in pii.op4_pii(spark, odd).collect()] == [1, 1]
    for n in (1, 63, 64, 65, 129, 1000):
        row = spark.range(1).select(pii.running_sums(F.sequence(F.lit(1).cast("bigint"), F.lit(n).cast("bigint"))).alias("s")).first()
        assert row.s == [k * (k + 1) // 2 for k in range(1, n + 1)]


def test_iban_before_capitals_and_digits(spark):
    compact, grouped = "DE89370400440532013000", "DE89 3704 0044 0532 0130 00"
    values = [compact, grouped, "NO9386011117947", "GB82 WEST 1234 5698 7654 32", "MT84MALT011000012345MTLCAST001S"]
    texts, want = [], []
    for value in values:
        for after in (" Please pay", " BIC COBADEFF", " 2024", " A", " 7", ".", "", f" {compact}"):
            texts.append(f"IBAN {value}{after}")
            want.append([f"iban:5:{5 + len(value)}"] + ([f"iban:{6 + len(value)}:{6 + len(value) + 22}"] if compact in after else []))
    texts += [f"IBAN {compact}7", f"IBAN X{compact}", "IBAN DE88370400440532013000 Please"]
    want += [[], [], []]
    got = pii.op4_pii(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).sort("doc_id").collect()
    for text, r, spans in zip(texts, got, want, strict=True):
        assert [x for x in r.spans.split(",") if x.startswith("iban")] == spans, text


def test_iban_of_unlisted_country(spark):
    rest = "123456789012345"
    check = 98 - int("".join(str(int(c, 36)) for c in rest + "ZZ00")) % 97
    value = f"ZZ{check:02d}{rest}"
    grouped = " ".join(value[k : k + 4] for k in range(0, len(value), 4))
    texts = [f"{value} Please", f"{grouped} please", f"{value} 2024"]
    got = pii.op4_pii(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).sort("doc_id").collect()
    assert [[x for x in r.spans.split(",") if "iban" in x] for r in got] == [[f"iban:0:{n}"] for n in (len(value), len(grouped), len(value))]


def test_context_on_both_sides_and_over_other_matches(spark):
    texts = ["SSN: 123-45-6789, 234-56-7890", "123-45-6789 (SSN)", "123-45-6789, 234-56-7890 (SSN)", "SSN " + "." * 36 + "123-45-6789", "SSN " + "." * 37 + "123-45-6789", "123-45-6789" + "." * 37 + "SSN", "123-45-6789" + "." * 38 + "SSN"]
    texts += ["beb071129071368dda607a748490d0e86b5901a8 (api_key)", "beb071129071368dda607a748490d0e86b5901a8 and a token"]
    got = pii.op4_pii(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).sort("doc_id").collect()
    assert [r.spans for r in got] == ["ssn:5:16,ssn:18:29", "ssn:0:11", "ssn:0:11,ssn:13:24", "ssn:40:51", "", "ssn:0:11", "", "secret:0:40", ""]


def test_scores_by_windows_of_the_text(spark):
    rng = random.Random(6)
    parts = ["a@b.cd", "10.0.0.1", "123-45-6789", "4111111111111111", "+1 555 010 9999", "é", "👍", " ", "/", "\n", "mail ", "ssn ", "host ", "card ", "fax ", "." * 9, "1.2.3.4.5.6.7.8"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(400)] + ["a@b.c " * 3000, "1.2" * 200 + " card"]
    kinds = {k.name: k for k in pii.KINDS}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen = 0
    for r in pii.find_spans(docs, least_score=0.0).collect():
        for s in r.spans:
            kind, text = kinds[s.kind], texts[r.doc_id]
            behind, ahead = text[max(0, s.start - 40) : s.start].lower(), text[s.end : s.end + 40].lower()
            met = re.search(kind.context, behind) or re.search(kind.context_after or kind.context, ahead)
            assert s.score == (kind.raised if met else kind.score), (s, text[:200])
            seen += 1
    assert seen > 3000
