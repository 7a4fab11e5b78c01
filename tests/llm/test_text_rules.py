"""Quality rules and personal data against plain Python."""

import hashlib
import re
from collections import Counter

import pytest
import regex
from pyspark.sql import functions as F

from cladeframe.llm import pii, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    n, r = len(words), len(covered)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), r, n < 50 or 100 * r > 50 * n


@pytest.mark.parametrize("which", ["edge", "documents"])
def test_quality(which, request):
    docs = request.getfixturevalue(which)
    got = Counter(tuple(r)[:7] for r in quality.line_quality(docs).drop("cleaned", "kept").collect())
    assert got == Counter((r.doc_id, *base_counts(r.text)) for r in docs.select("doc_id", "text").collect())


def test_quality_lines(spark):
    good = "This is a line of plain prose that ends as it should.\n" * 1
    many = "".join(" ".join(f"w{7 * i + k}" for k in range(9)) + ".\n" for i in range(12))
    rows = [(1, many), (2, many + "Home | About | News | Contact\n"), (3, "Home | About | News | Contact us today now\n" * 20 + good), (4, "WHAT!! NOW!! BUY!! IT!! HERE!!\n" * 15)]
    got = {r.doc_id: r for r in quality.line_quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].kept for i in (1, 2, 3, 4)] == [True, True, False, False]
    assert got[2].cleaned == many and got[2].n_bad_lines == 1
    assert quality.line_quality(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
HARD = [
    "a@b.c_x@d.e a@1.2.3.4 1.2.3.4.5.6.7.8 999.1.1.1", "é +1 (234) 567-8901 4111 1111 1111 1111", "card 4111-1111-1111-1111, 5500005555555559",
    "001.002.003.255 1.1.1.256", "+" * 50 + "1" * 20, "a.b@c.d.e-f.g.", "a@b.c " * 300, "1.1.1." * 500, "+12 34 (567) 89.01-2", None,
]


def base_spans(text):
    def good(kind, m):
        digits = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(x) <= 255 for x in m.split("."))
        if kind == "card":
            return 14 <= len(digits) <= 19 and luhn(digits)
        return kind != "phone" or 10 <= len(digits) <= 15

    found = [(m.start(), o, m.end(), k) for o, (k, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if good(k, m.group())]
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(found)]


def test_pii(spark, edge, documents):
    hard = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(HARD)], "doc_id long, text string")
    docs = hard.unionByName(edge.select("doc_id", "text")).unionByName(documents.select("doc_id", "text"))
    want = Counter()
    for r in docs.collect():
        spans = base_spans(r.text)
        kinds = Counter(s.split(":")[0] for s in spans)
        want[(r.doc_id, *(kinds[k] for k in PATTERNS), hashlib.sha256(",".join(spans).encode()).hexdigest())] += 1
    got = pii.pii_digest(docs).collect()
    assert Counter(tuple(r)[:6] for r in got) == want


def test_pii_more_kinds_and_mask(spark):
    rows = [
        (1, "IBAN DE89370400440532013000 and GB82 WEST 1234 5698 7654 32, not DE00370400440532013000"),
        (2, "ssn 123-45-6789 but 000-45-6789 is none"),
        (3, 'TOKEN = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"'),
        (4, "call 555-123-4567 today; order 555-123-4567"),
        (5, "mail a@1.2.3.4 now"),
        (6, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("found", F.lit("x"))
    spans = {r.doc_id: [s.split(":")[0] for s in r.spans.split(",") if s] for r in pii.pii_digest(docs).collect()}
    assert spans == {1: ["iban", "iban"], 2: ["ssn"], 3: ["secret"], 4: ["local_phone", "local_phone"], 5: ["email", "ip"], 6: []}
    masked = pii.mask_pii(docs)
    assert masked.columns == docs.columns
    text = {r.doc_id: r.text for r in masked.collect()}
    assert text[1] == "IBAN <IBAN> and <IBAN>, not DE00370400440532013000"
    assert text[5] == "mail <EMAIL> now" and text[6] is None
    assert pii.pii_digest(docs.limit(0)).collect() == []


def test_native_plans(documents):
    for df in (quality.line_quality(documents), pii.pii_digest(documents), pii.mask_pii(documents)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not [x for x in ("Python", "Pandas", "Arrow") if x in plan]


def test_pii_context_on_both_sides(spark):
    """A context word counts for every match within 40 characters of it, whatever stands between."""
    number = "555-987-6543"
    rows = [f"phone: 555-123-4567, {number}", f"phone {number}, 123-45-6789, {number}", f"é call{'x' * 36}{number}", f"é call{'x' * 37}{number}"]
    rows += [" ".join(["tel", *[number] * 7]), f"{number}, {number} phone", f"{number}{'x' * 35} call é", f"{number} {'x' * 35} call é"]
    rows += [" ".join([*[number] * 7, "tel"]), f"ssn 000-12-3456 or 123-45-6789 {number}", f"{number} " * 9 + "fax"]
    want = {}
    for i, t in enumerate(rows):
        found = [(m.start(), m.end()) for m in re.finditer("(?<![0-9+(.-])555-[0-9]{3}-[0-9]{4}(?![0-9.-])", t)]
        want[i] = [a for a, b in found if re.search("phone|tel|call|fax", t[max(0, a - 40) : a] + "\n" + t[b : b + 40])]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: [int(s.split(":")[1]) for s in r.spans.split(",") if s.startswith("local")] for r in pii.pii_digest(docs).collect()}
    assert got == want and [len(want[i]) for i in range(11)] == [2, 2, 1, 0, 3, 2, 1, 0, 3, 0, 3]
    assert {r.doc_id: r.text for r in pii.mask_pii(docs).collect()}[0] == "phone: <LOCAL_PHONE>, <LOCAL_PHONE>"


def mod97(m):
    plain = m.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


VALID = {
    "email": lambda m: True,
    "ip": lambda m: all(int(x) <= 255 for x in m.split(".")),
    "card": lambda m: 14 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m)),
    "phone": lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15,
    "iban": mod97,
    "ssn": lambda m: m[:3] not in ("000", "666") and m[0] != "9" and m[4:6] != "00" and m[7:] != "0000",
    "local_phone": lambda m: True,
    "secret": lambda m: any(c in "0123456789" for c in m),
}


def all_spans(text):
    """Spans and scores of every kind, one match at a time."""
    out = []
    for order, kind in enumerate(pii.KINDS):
        for m in regex.finditer(kind.pattern, text):
            if VALID[kind.name](m.group()):
                sides = text[max(0, m.start() - 40) : m.start()], text[m.end() : m.end() + 40]
                score = round(min(1.0, kind.score + (0.2 if any(regex.search(kind.context, x) for x in sides) else 0)), 6)
                if kind.base or score >= 0.6:
                    out.append((m.start(), order, m.end(), kind.name, score))
    return sorted(out)


def masked(text):
    out, at, until = [], 0, 0
    for a, _, b, kind, _ in all_spans(text):
        if a >= until:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = until = max(until, b)
    return "".join([*out, text[at:]])


BITS = ["a.b@c.de", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (234) 567-8901", "+12 3", "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "DE00370400440532013000", "123-45-6789", "000-45-6789"]
BITS += ["555-123-4567", "(555) 123-4567", "token=abcdefgh12345678zz", "api_key: 'abcdefghijklmnopqrs'", " ", "  ", ", ", "\n", "é", "漢字", "🙂", "plain words", "call", "Phone:", "ssn", "account", "card", "server", "host", "mail", "credentials", "x" * 39, "0", "-", ".", "@"]


def test_pii_of_every_kind(spark, rng, documents, edge):
    """Spans, scores and masked texts of all kinds, with up to hundreds of spans in a text."""
    texts = ["".join(rng.choice(BITS) for _ in range(rng.choice([3, 10, 40]))) for _ in range(300)]
    texts += [" ".join(rng.choice(BITS) for _ in range(n)) for n in (200, 500, 1500)] + ["a@b.c " * n for n in (63, 64, 65, 128, 129)]
    rows = [(10_000 + i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(documents.select("doc_id", "text")).unionByName(edge.select("doc_id", "text"))
    want, hidden = Counter(), Counter()
    for r in docs.collect():
        spans = all_spans(r.text or "")
        want[(r.doc_id, ",".join(f"{k}:{a}:{b}" for a, _, b, k, _ in spans), ",".join(str(s) for *_, s in spans))] += 1
        hidden[(r.doc_id, None if r.text is None else masked(r.text))] += 1
    assert Counter((r.doc_id, r.spans, r.scores) for r in pii.pii_digest(docs).collect()) == want
    assert Counter((r.doc_id, r.text) for r in pii.mask_pii(docs).collect()) == hidden
