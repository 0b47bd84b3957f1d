import hashlib
import random
import re

from panelspark.llm.catalog import QUERIES
from panelspark.llm.pii import find_pii, redact

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def base(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(d) <= 19 and luhn(d)):
                continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def expected(text):
    spans = base(text)
    listed = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    return {k: sum(s[0] == k for s in spans) for k in PATTERNS}, hashlib.sha256(listed.encode()).hexdigest(), listed


def agrees(row, text):
    counts, digest, listed = expected(text)
    assert {k: row[f"n_{k}"] for k in counts} == counts, text
    assert row["base_sha256"] == digest, text
    assert set(listed.split(",")) - {""} <= set(row["spans"].split(",")), text


def test_query_equals_plain_search(spark, folder):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op7_pii"](spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        agrees(r, texts[r.doc_id])


def test_odd_texts_equal_plain_search(spark):
    rng = random.Random(3)
    parts = ["a@b.c", "_d@e.f", "@", ".", "+1 (017) 555-7713", "4111 1111 1111 1111", "1.2.3.4", "256.1.1.1", "0001.02.3.255", "é", "𝔘", " ", "-",
             "12345678901234567890", "+", "x%y", "37828224631000 5", "(", ")", "\n", "00", "a", "1.2.3.4.5.6.7.8", "\\", "'", " "]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 14))) for _ in range(400)]
    texts += ["9" * 100_000, "a" * 60_000 + "@", "1." * 4_000, "+1" + " " * 50_000, "a@b" + ".c" * 30_000, "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = find_pii(df).collect()
    assert len(rows) == len(texts)
    for r in rows:
        agrees(r, texts[r.doc_id])


def test_added_kinds_need_checksum_or_context(spark):
    texts = ["pay GB82 WEST 1234 5698 7654 32 now", "pay GB83 WEST 1234 5698 7654 32 now", "her social 123-45-6789 x", "part 123-45-6789 x"]
    rows = find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.spans for r in rows] == ["iban:4:31", "", "ssn:11:22", ""]


def test_iban_ends_where_its_country_says(spark):
    gb, de, no = "GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "NO93 8601 1117 947"
    texts = [f"IBAN {gb} BIC", f"{de} 2024", f"{gb} {de} {no} OK 7", f"{de} {gb} 1", f"AT12 {gb} AB12 {no}", f"{gb}X", f"{no} 1 {de[:-1]} 9 SUM", "XX12 " * 9 + de]
    rows = find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    ibans = [[t[s.start:s.end] for s in r.found if s.kind == "iban"] for r, t in zip(rows, texts)]
    assert ibans == [[gb], [de], [gb, de, no], [de, gb], [gb, no], [], [no], [de]]
    assert redact(spark.createDataFrame([(1, f"IBAN {gb} BIC")], "doc_id long, text string")).first().text == "IBAN [IBAN] BIC"


def test_redaction_keeps_columns_and_nulls(spark):
    rows = [(1, "mail a@b.co, +1 (017) 555-7713!", 5), (1, None, 6), (None, "", 7), (2, "é 1.2.3.4", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _text int")
    got = redact(df)
    assert got.columns == df.columns
    assert sorted(got.collect(), key=str) == sorted([(1, "mail [EMAIL], [PHONE]!", 5), (1, None, 6), (None, "", 7), (2, "é [IP]", None)], key=str)
    assert redact(df.limit(0)).count() == 0 and find_pii(df.limit(0)).count() == 0


def test_plan_stays_in_the_jvm(spark, folder):
    plan = QUERIES["op7_pii"](spark, folder)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_texts_of_many_matches_equal_plain_search(spark):
    """Parts of a fold meet without a seam, whatever the number of matches; a megabyte of addresses is no problem."""
    from time import perf_counter
    iban = "GB82 WEST 1234 5698 7654 32"
    texts = [" ".join(f"1.2.{n % 256}.{k % 300}" for k in range(n)) for n in (1, 127, 128, 129, 255, 256, 257, 1000)]
    texts += ["a@b.co 1.2.3.4, " * 500, f"{iban} {iban}; " * 200, "10.0.0.1 " * 120_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    start = perf_counter()
    rows = {r.doc_id: r for r in find_pii(df).collect()}
    clean = {r.doc_id: r.text for r in redact(df).collect()}
    assert perf_counter() - start < 300  # a fold that copies all it has gathered takes far longer
    for i, text in enumerate(texts):
        agrees(rows[i], text)
        at, out = 0, []
        for kind, a, b in sorted([(s.kind, s.start, s.end) for s in rows[i].found], key=lambda s: (s[1], -s[2])):
            if a >= at:
                out += [text[at:a], f"[{kind.upper()}]"]
            at = max(at, b)
        assert clean[i] == "".join(out) + text[at:]
    assert sum(s.kind == "iban" for s in rows[9].found) == 400
