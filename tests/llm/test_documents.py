"""Near-duplicates, decontamination, language, URL rules, chats and the pipeline."""

import hashlib
import math
import re
import zlib
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from cladeframe.llm import chat, decontam, langid, orderminhash, urlrules
from cladeframe.llm.queries import QUERIES, SQL, URL_RULES

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def shingles(text):
    """Five-word shingles in order, each with the number of its occurrence."""
    w = words(text)
    seen, out = Counter(), []
    for i in range(max(1, len(w) - 4) if w else 0):
        x = tuple(w[i : i + 5])
        out.append((x, seen[x]))
        seen[x] += 1
    return out


def similarity(a, b):
    """Share of shingles in a longest common subsequence, cell by cell."""
    if not a or not b or 2 * len(set(a) & set(b)) < 0.8 * (len(a) + len(b)):
        return 0.0
    row = [0] * (len(b) + 1)
    for x in a:
        last, row = row, [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
    return row[-1] / (len(a) + len(b) - row[-1])


def classes(docs):
    """Connected components of texts that are equal or align at 0.8."""
    own = {t: shingles(t) for t in {t or "" for _, t in docs}}
    top = {t: t for t in own}

    def find(t):
        while top[t] != t:
            t = top[t]
        return t

    texts = sorted(own)
    for i, a in enumerate(texts):
        for b in texts[i + 1 :]:
            if find(a) != find(b) and similarity(own[a], own[b]) >= 0.8:
                top[find(a)] = find(b)
    return {t: find(t) for t in own}


def test_near_duplicates(spark, edge, rng):
    vocabulary = [f"w{i}" for i in range(500)]
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    for g in range(4):
        base = [rng.choice(vocabulary) for _ in range(120)]
        for k in range(25):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((1000 * (g + 1) + k, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit(1))
    root = classes(rows)
    groups = {}
    for i, t in rows:
        groups.setdefault(root[t or ""], []).append(i)
    want = Counter((i, min((x for x in groups[root[t or ""]] if x is not None), default=None), len(groups[root[t or ""]])) for i, t in rows)
    assert Counter(tuple(r) for r in orderminhash.near_duplicates(docs).collect()) == want
    kept = orderminhash.drop_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert orderminhash.near_duplicates(docs.limit(0)).collect() == []


def test_blocks_of_a_large_bucket(spark, rng, monkeypatch):
    """Texts that share sketches but not classes are compared in blocks, and no link is lost."""
    monkeypatch.setattr(orderminhash, "BLOCK_TEXTS", 4)
    vocabulary = [f"w{i}" for i in range(300)]
    common = [rng.choice(vocabulary) for _ in range(80)]
    rows = []
    for g in range(12):
        own = [rng.choice(vocabulary) for _ in range(22)]
        for k in range(2):
            w = common + own
            w[rng.randrange(80)] = rng.choice(vocabulary)
            rows.append((10 * g + k, " ".join(w)))
    root = classes(rows)
    groups = {}
    for i, t in rows:
        groups.setdefault(root[t], []).append(i)
    got = {r.doc_id: r.class_id for r in orderminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: min(groups[root[t]]) for i, t in rows}


def test_components(spark, rng):
    edges = [(bytes([rng.randrange(60)]), bytes([rng.randrange(60)])) for _ in range(45)] + [(bytes([100 + i]), bytes([101 + i])) for i in range(20)]
    top = {}

    def find(x):
        top.setdefault(x, x)
        while top[x] != x:
            x = top[x]
        return x

    for a, b in edges:
        lo, hi = sorted((find(a), find(b)))
        top[hi] = lo
    got = {bytes(r.node): bytes(r.root) for r in orderminhash.components(spark.createDataFrame(edges, "a binary, b binary")).collect()}
    assert got == {x: find(x) for x in top if find(x) != x}


def hits(docs, items, window):
    known = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            known.setdefault(tuple(w[k : k + window]), set()).add(i)
    sizes = sorted({len(x) for x in known})
    out = Counter()
    for i, t in docs:
        w = words(t)
        hit, seen = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in known:
                    hit |= set(range(k, k + n))
                    seen |= {str(y) for y in known[x] if y is not None}
        out[(i, len(w), len(hit), len(seen), hashlib.sha256(",".join(sorted(seen)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w))] += 1
    return out


@pytest.mark.parametrize("window,block", [(3, 10**6), (3, 8), (13, 10**6)])
def test_decontamination(spark, edge, rng, window, block):
    docs = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 40)))) for i in range(150)] + [(r.doc_id, r.text) for r in edge.collect()]
    items = [(i, " ".join(rng.choice("abcd") for _ in range(rng.randint(0, 9)))) for i in range(12)] + [(3, "a b"), (None, "c c a"), (50, None), (51, ""), (52, "One")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("__hit", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = Counter(tuple(r) for r in decontam.contamination_digest(frame, bench, window=window, block_words=block).collect())
    assert got == hits(docs, items, window)
    clean = decontam.decontaminate(frame, bench, window=window, block_words=block)
    assert clean.columns == frame.columns and clean.count() == sum(n for k, n in got.items() if not k[5])
    none = decontam.contamination_digest(frame, bench.limit(0))
    assert none.where("n_hit > 0").count() == 0


def test_language(spark, edge, documents):
    got = langid.language_digest(documents, PIECES).collect()
    truth = {r.doc_id: r.lang for r in documents.collect()}
    held = [r for r in got if r.held_out]
    assert len(got) == len(truth) and sum(truth[r.doc_id] == r.lang_pred for r in held) >= 0.95 * len(held)
    rows = langid.language_digest(edge, PIECES).collect()
    assert len(rows) == edge.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.lang_pred for r in rows if r.doc_id in (0, 1, 2, 9)} == {"und"}
    assert langid.language_digest(edge.limit(0), PIECES).collect() == []


def ways(word, value, unknown, longest):
    """Sums over all segmentations of the sign of a word's start and a word: up to each place, and from it on."""
    text = "▁" + word
    steps = []
    for a in range(len(text)):
        own = [(b, text[a:b], value[text[a:b]]) for b in range(a + 1, min(len(text), a + longest) + 1) if text[a:b] in value]
        if not any(b == a + 1 for b, _, _ in own):
            own.append((a + 1, None, unknown))
        steps.append(own)
    ahead, behind = [Fraction(0)] * (len(text) + 1), [Fraction(0)] * (len(text) + 1)
    ahead[0] = behind[-1] = Fraction(1)
    for a in range(len(text)):
        for b, _, p in steps[a]:
            ahead[b] += ahead[a] * p
    for a in reversed(range(len(text))):
        behind[a] = sum(behind[b] * p for b, _, p in steps[a])
    return steps, ahead, behind


def log_of(x):
    return math.log(x.numerator) - math.log(x.denominator)


TOY = ["▁", "a", "b", "ab", "▁a", "ba", "bab", "c", "abc", "é", "aaaa"]
RUNS = ["", "a", "ab", "babab", "abcab", "xyz", "aéb", "q", "a" * 29, "a" * 30, "a" * 31, "abcab" * 8, "x" * 60, "bab" * 20]


def test_segmentations_are_summed_at_any_length(rng):
    """Plain and logarithmic passes against exact fractions, on both sides of PLAIN_LETTERS."""
    table = np.array([[rng.random() / 9 for _ in range(3)] for _ in TOY])
    trie = langid.Pieces(TOY)
    full = np.vstack([table, np.full((1, 3), langid.UNKNOWN)])
    got = langid.log_probabilities(trie, full, RUNS)
    times = np.arange(1.0, len(RUNS) + 1)
    for k in range(3):
        value = {p: Fraction(table[i, k]) for i, p in enumerate(TOY)}
        want = dict.fromkeys([*TOY, None], 0.0)
        for j, run in enumerate(RUNS):
            steps, ahead, behind = ways(run, value, Fraction(langid.UNKNOWN), 4)
            assert math.isclose(got[j, k], log_of(ahead[-1]), rel_tol=1e-9)
            for a, own in enumerate(steps):
                for b, piece, p in own:
                    want[piece] += times[j] * float(ahead[a] * p * behind[b] / ahead[-1])
        counts = langid.expected_counts(trie, full[:, k], RUNS, times)
        assert np.allclose(counts, [want[p] for p in [*TOY, None]], rtol=1e-6)


def test_language_query_against_plain_python(spark, monkeypatch):
    """Every row of op7 on a small table: learning, held-out rows, nulls, ties and long words."""
    import sentencepiece

    rows = [(1, "the cat and the hat", "en"), (2, "der hund und das haus", "de"), (3, "le chat et la maison", "fr"), (4, "the dog and the log", "en"), (5, "und der baum das", "de")]
    rows += [(6, "la table et le pain", "fr"), (7, "and that", None), (8, None, "en"), (9, "123 --", "de"), (10, "donaudampfschifffahrtsgesellschaftskapitaen", "de"), (11, "ÀÉ. der x2y", None)]
    rows += [(12, "", "fr"), (13, "the", "en"), (13, "the", "en"), (None, "et la", "fr"), (14, "漢字", None), (15, "chat der cat", "de"), (16, "²", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    pieces = [model.id_to_piece(i) for i in range(model.vocab_size())]
    longest = max(map(len, pieces))

    def runs(text):
        out = []
        for w in re.findall("[a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")):
            out.append(re.findall(r"[^\W\d_]+", w if w.isascii() else w.lower()))
        return out

    def held(i):
        return i is not None and zlib.crc32(str(i).encode()) % 4 == 2

    known = [(t, lang) for i, t, lang in rows if i is not None and not held(i) and t is not None and lang is not None]
    languages = sorted({lang for _, lang in known})
    table = {lang: dict.fromkeys(pieces, 1 / len(pieces)) for lang in languages}
    for _ in range(langid.ROUNDS):
        for lang in languages:
            counts = dict.fromkeys(pieces, 0.05)
            for t, own in known:
                for run in (r for w in runs(t) for r in w if own == lang):
                    steps, ahead, behind = ways(run, table[lang], langid.UNKNOWN, longest)
                    for a, arcs in enumerate(steps):
                        for b, piece, p in arcs:
                            if piece is not None:
                                counts[piece] += float(ahead[a]) * p * float(behind[b]) / float(ahead[-1])
            total = sum(counts.values())
            table[lang] = {p: c / total for p, c in counts.items()}
    want = Counter()
    for i, t, _ in rows:
        words_ = runs(t)
        if not any(c.isalpha() for c in t or ""):
            want[(i, held(i), "und", 0.0)] += 1
            continue
        mean = {}
        for lang in languages:
            logs = [math.log(float(ways(r, table[lang], langid.UNKNOWN, longest)[1][-1])) for w in words_ for r in w]
            mean[lang] = sum(logs) / len(words_)
        top = max(mean.values())
        best = min(lang for lang in languages if mean[lang] > top - 1e-9)
        want[(i, held(i), best, round(1 / sum(math.exp(m - top) for m in mean.values()), 4))] += 1
    got = langid.language_digest(docs, PIECES).collect()
    assert Counter((r.doc_id, r.held_out, r.lang_pred, round(r.score, 4)) for r in got) == want


def url_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
    path = rest[end:]
    stop = min([path.find(c) for c in "?#" if c in path] + [len(path)])
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), path[:stop]


def fixed(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_url_rules(spark):
    urls = [None, "", "x", "http://", "http://A.COM", "http://a.com?x/en/", "HTTP://X.example.com/en/7?", "http://com/en/", "http://xcom/en/", "a://b://c/d", "http://É.net/de/8#", "http://a.example.net/de/8/\n9", "http://spam.net/q?a=1", "http://spam.net/q?a=1"]
    pages = [(i % 9, u) for i, u in enumerate(urls)] + [(i, "http://bad.spam.io/x") for i in range(100, 140)] + [(i, "http://good.fine.io/x") for i in range(200, 260)] + [(None, "http://new.spam.io/zzz")]
    labels = [(i, 0, 0) for i in range(100, 130)] + [(i, 1, 0) for i in range(200, 250)] + [(None, 0, 1), (100, None, None)]
    frame = spark.createDataFrame(pages, "page_id long, url string").withColumn("host", F.lit(1))
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = Counter()
    for i, u in pages:
        host, path = url_parts(u)
        rule, verdict = fixed(host, path)
        want[(i, host, path, rule, verdict or ("block" if u and "spam" in u else "allow"))] += 1
    assert Counter(tuple(r)[:5] for r in urlrules.filter_urls(frame, known, URL_RULES).collect()) == want
    assert urlrules.filter_urls(frame.limit(0), known.limit(0), URL_RULES).collect() == []


def test_mined_rules_against_brute_force(spark, rng):
    rows = [(i, sorted({rng.choice("abcdef") for _ in range(3)}), None) for i in range(300)]
    rows = [(i, t, ("a" in t and "b" in t) or rng.random() < 0.02) for i, t, _ in rows]
    df = spark.createDataFrame(rows, "id long, tokens array<string>, bad boolean")
    got = {tuple(r.tokens): round(r.confidence, 9) for r in urlrules.mine_rules(df, "tokens", "bad", min_support=0.01, min_rows=5, min_confidence=0.6).collect()}
    from itertools import combinations

    found = {}
    for n in (1, 2, 3):
        for t in combinations("abcdef", n):
            own = [bad for _, tokens, bad in rows if set(t) <= set(tokens)]
            if sum(own) >= max(5, 3) and sum(own) / len(own) >= 0.6:
                found[t] = sum(own) / len(own)
    pruned = {t: round(c, 9) for t, c in found.items() if not any(set(s) < set(t) and found[s] >= c for s in found)}
    assert got == pruned
    hit = {tuple(r.tokens): round(r.confidence, 9) for r in urlrules.match_rules(df.select("tokens"), urlrules.mine_rules(df, "tokens", "bad", min_support=0.01, min_rows=5, min_confidence=0.6)).collect()}
    for _, tokens, _ in rows:
        best = max([c for t, c in pruned.items() if set(t) <= set(tokens)], default=None)
        assert hit.get(tuple(tokens)) == best


def test_template_language():
    render = chat.compile_template(
        "{% set n = 'A' %}{% for m in messages %}{{ loop.index }}{% if loop.last and not loop.first %}!{% elif 1 == 2 %}never{% endif %}"
        "{{ m['role'] | capitalize }}{% generation %}{{ m.text | escape }}{% endgeneration %};{% endfor %}{{ n ~ (1 + 2) }}{# gone #}"
    )
    assert render(messages=[{"role": "user", "text": "a#"}, {"role": "x", "text": None}]) == ("1Usera\\#;2!X;A3", [(5, 8), (12, 12)])
    assert chat.compile_template("{{ m.__class__ }}{{ messages.append }}")(m="s", messages=[]) == ("", [])
    assert chat.fold(chat.parse("a{{ 'b' ~ 1 }}{% if 1 == 1 %}c{% endif %}")) == (chat.Print(chat.Const("ab1c")),)
    for bad in ("{{ a.b() }}", "{% for %}", "{{ x | eval }}", "{% if a %}", "{{ 'a }}", "{% import os %}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)


def test_values_without_meaning():
    given = {"n": 3, "l": ["a"], "m": {"k": "v"}}
    for source, want in [("{{ x | length }}", "0"), ("{{ 'a' in x }}", "false"), ("{{ x ~ 'a' }}", "a"), ("{{ l | length }}", "1"), ("{{ m[l] }}{{ m.k }}", "v"), ("{{ x.y.z }}", "")]:
        assert chat.compile_template(source)(**given)[0] == want
    for source in ("{{ x + 'a' }}", "{{ x < 1 }}", "{{ n + 'a' }}", "{{ n | length }}", "{{ 'a' in n }}", "{% for y in x %}{% endfor %}", "{{ l }}", "{{ m == 1 or -1 }}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(source)(**given)


SEGMENTED = [
    "<s>{% for m in messages %}[{{ loop.index }}{% if loop.last %}!{% endif %}]{% endfor %}</s>",
    "{{ bos }}{% set n = 0 %}{% for m in messages %}{% if loop.first %}{% set n = 5 %}{% endif %}{% set n = n + 1 %}{{ n }}{{ m.text }}{% generation %}{{ m.role }}{% endgeneration %};{% endfor %}={{ n }}{{ m }}{{ loop }}{% if ask %}{% generation %}?{% endgeneration %}{% endif %}",
    "{{ messages | length }}:{% for m in messages %}{{ m.text }},{% endfor %}{% for m in messages %}{{ m.role }}.{% endfor %}",
    "{% if bos %}{% for m in messages %}{{ m.text }}{% endfor %}{% endif %}",
    "none of it",
]


@pytest.mark.parametrize("source", SEGMENTED)
def test_segments_resume_one_rendering(spark, source):
    """Text and loss of conversations of 1 to 9 turns, in rows of 1 to 20 turns, are those of one rendering."""
    turns = [(c, t, "user" if t % 2 else "assistant", f"t{t}") for c in range(1, 10) for t in range(c)]
    names = {"bos": "<b>", "ask": True}
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    render = chat.compile_template(source)
    for size in (1, 2, 3, 20):
        rows = chat.format_chats(df, source, segment_turns=size, names=names).collect()
        for c in range(1, 10):
            want, spans = render(messages=[{"role": r, "text": x} for k, _, r, x in turns if k == c], **names)
            own = [r for r in rows if r.conv_id == c]
            assert [r.segment for r in own] == list(range(len(own)))
            assert "".join(r.formatted for r in own) == want
            assert "|".join(r.formatted[x.start : x.end] for r in own for x in r.loss) == "|".join(want[a:b] for a, b in spans)
            if source in SEGMENTED[:2]:
                assert len(own) == -(-c // size)
    with pytest.raises(chat.TemplateError):
        chat.format_chats(df, source, names={"f": len})


def test_chats(spark):
    turns = [(1, 2, "assistant", "second"), (1, 1, "user", "</turn>\n### user: x"), (1, 3, None, None), (None, 1, "assistant", "\\"), (2, None, "system", "a:b"), (2, 1, "assistant", "z"), (2, 1, "assistant", "z")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("loss", F.lit(1))
    for size in (4096, 2):
        got = {r.conv_id: r for r in chat.read_chats(chat.format_chats(df, segment_turns=size)).collect()}
        want = {1: [("user", "</turn>\n### user: x"), ("assistant", "second"), ("", "")], None: [("assistant", "\\")], 2: [("system", "a:b"), ("assistant", "z"), ("assistant", "z")]}
        assert set(got) == set(want)
        for c, rows in want.items():
            own = "".join(t for r, t in rows if r == "assistant")
            assert got[c].n_turns == len(rows) and got[c].loss_chars == len(own)
            assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in rows).encode()).hexdigest()
            assert got[c].loss_sha256 == hashlib.sha256(own.encode()).hexdigest()
    assert chat.read_chats(chat.format_chats(df.limit(0))).collect() == []


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_match_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = QUERIES[name](spark, sf)
    found = con.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    want = Counter(tuple(str(r[names.index(c)]) for c in df.columns) for r in found.fetchall())
    assert Counter(tuple(map(str, r)) for r in df.collect()) == want


def test_pipeline(spark, sf, documents):
    import corpus_pipeline

    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    texts = [(r.doc_id, r.text) for r in documents.collect()]
    root = classes(texts)
    first = {}
    for i, t in sorted(texts):
        first.setdefault(root[t], i)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    dirty = {k[0] for k in hits(texts, items, 13) if k[5]}
    assert set(rows) == set(first.values()) - dirty
    assert not [r for r in rows.values() if re.search(r"[A-Za-z0-9]@[A-Za-z0-9-]+\.[a-z]", r.decoded)]


def test_stages_on_hard_rows(spark, edge, sf, tmp_path):
    """Nulls in every column, repeated rows, clashing names and empty tables pass through every stage."""
    import corpus_pipeline

    docs = edge.withColumn("source", F.lit(None).cast("string")).withColumn("n_chars", F.lit(None).cast("bigint"))
    empty = docs.limit(0)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out, none = stage(spark, docs, sf), stage(spark, empty, sf)
        out.write.parquet(str(tmp_path / name))
        back = spark.read.parquet(str(tmp_path / name))
        if k + 1 < len(corpus_pipeline.STAGES):
            assert back.columns == docs.columns
        assert none.count() == 0 and 0 < back.count() <= docs.count()
        docs = back if k + 1 < len(corpus_pipeline.STAGES) else docs
    kept = [r.text for r in docs.collect()]
    assert kept.count("same text") == 1 and None not in kept and "one" in kept


def test_recall_by_kind_of_edit(spark, rng):
    """Pairs that align at 0.8 are found whatever the edit was: words, moved or repeated lines, cuts. No others are."""
    vocabulary = [f"v{i}" for i in range(2000)]
    rows, kinds = [], ("words", "moved", "repeated", "cut", "shuffled")
    for g in range(200):
        lines = [" ".join(rng.choice(vocabulary) for _ in range(22)) for _ in range(12)]
        kind, new = kinds[g % 5], list(lines)
        if kind == "words":
            for k in rng.sample(range(12), rng.randint(1, 6)):
                new[k] = new[k].replace(rng.choice(new[k].split()), "changed", 1)
        elif kind == "moved":
            new.insert(rng.randrange(12), new.pop(rng.randrange(12)))
        elif kind == "repeated":
            new.insert(rng.randrange(12), new[rng.randrange(12)])
        elif kind == "cut":
            del new[: rng.randint(1, 2)]
        else:
            rng.shuffle(new)
        rows += [(10 * g, "\n".join(lines)), (10 * g + 1, "\n".join(new))]
    text = dict(rows)
    linked = {g for g in range(200) if text[10 * g] == text[10 * g + 1] or similarity(shingles(text[10 * g]), shingles(text[10 * g + 1])) >= 0.8}
    count = Counter(kinds[g % 5] for g in linked)
    assert min(count[k] for k in kinds[:4]) >= 10 and count["shuffled"] <= 2
    got = {r.doc_id: r.class_id for r in orderminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - 1 if i % 10 and i // 10 in linked else i for i, _ in rows}


def test_mined_rule_of_four_tokens(spark):
    """Bad only where four tokens meet: every three of them are in as many good rows."""
    rows = [(list("abcd"), True)] * 30 + [([x for x in "abcd" if x != y], False) for y in "abcd" for _ in range(30)] + [(["z"], False)] * 30
    df = spark.createDataFrame(rows, "tokens array<string>, bad boolean")
    got = urlrules.mine_rules(df, "tokens", "bad", min_support=0.01, min_rows=5, min_confidence=0.8)
    assert [(r.tokens, r.confidence) for r in got.collect()] == [(list("abcd"), 1.0)]
    assert urlrules.match_rules(df.select("tokens").distinct(), got).count() == 1


def test_mined_verdicts_over_a_corpus(spark, rng):
    """Verdicts of 1,500 URLs by rules mined from 1,000 labels, against every combination of up to four tokens."""
    hosts = [f"{a}.{b}.{c}" for a in ("www", "blog", "m") for b in ("spam", "fine", "mixed") for c in ("com", "net")]
    words_ = ["win", "cash", "news", "prize", "about"]
    urls = [f"{rng.choice(['http', 'https'])}://{rng.choice(hosts)}/{rng.choice(words_)}/{rng.choice(words_)}/{i}" for i in range(1500)]
    rows = list(enumerate(urls))
    bad = {i: ("spam" in u and ".net" in u) or ("win" in u and "cash" in u and "blog" in u) or rng.random() < 0.03 for i, u in rows}
    labels = [(i, 1, int(bad[i])) for i in range(1000)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    tokens = {r.page_id: frozenset(r.t) for r in pages.select("page_id", urlrules.url_tokens(F.col("url")).alias("t")).collect()}
    from itertools import combinations

    counts, hits = Counter(), Counter()
    for i in range(1000):
        for n in (1, 2, 3, 4):
            for c in combinations(sorted(tokens[i]), n):
                counts[c] += 1
                hits[c] += bad[i]
    rules = [frozenset(c) for c in counts if hits[c] >= 20 and hits[c] / counts[c] >= 0.8]
    assert len(rules) > 5
    want = {i: "block" if any(r <= tokens[i] for r in rules) else "allow" for i, _ in rows}
    got = urlrules.filter_urls(pages, known, []).collect()
    assert {r.page_id: r.verdict for r in got} == want and len(got) == 1500
    assert 100 < sum(v == "block" for v in want.values()) < 900
    mined = urlrules.mine_rules(pages.join(known, F.col("page_id") == F.col("doc_id")).select(urlrules.url_tokens(F.col("url")).alias("tokens"), (F.col("toxic") == 1).alias("bad")), "tokens", "bad")
    for r in mined.collect():
        own = [i for i in range(1000) if set(r.tokens) <= tokens[i]]
        assert abs(r.confidence - sum(bad[i] for i in own) / len(own)) < 1e-9


def test_chats_read_back_from_files(spark, tmp_path, rng):
    """Segments come in any order of files and splits; a missing or a second one is an error."""
    turns = [(c, t, ("user", "assistant")[t % 2], f"text {c} {t} " * rng.randint(0, 9)) for c in range(12) for t in range(rng.randint(1, 9))]
    turns += [(None, 0, "assistant", "of no conversation"), (None, 1, None, None)]
    formatted = chat.format_chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), segment_turns=2)
    want = Counter(tuple(r) for r in chat.read_chats(formatted).collect())
    assert len(want) == 13
    formatted.orderBy("formatted").repartition(5).write.parquet(str(tmp_path / "chats"))
    again = spark.read.parquet(str(tmp_path / "chats"))
    assert Counter(tuple(r) for r in chat.read_chats(again).collect()) == want
    for wrong in (again.where("segment <> 0"), again.where("segment <> 1 OR conv_id <> 3 OR conv_id IS NULL").unionByName(again.where("segment = 0 and conv_id = 3"))):
        with pytest.raises(Exception, match="is missing or comes twice"):
            chat.read_chats(wrong).collect()


def test_slots_leave_out_no_similar_pair(rng):
    """Counts in slots bound what two texts share from above, repeats and long texts included."""
    vocabulary = [f"w{i}" for i in range(30)]
    texts = []
    for _ in range(30):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(5, 900))]
        texts.append(base)
        texts.append([w if rng.random() > 0.02 else rng.choice(vocabulary) for w in base])
    seqs = [np.array([hash(w) & 0xFFFFFFFF for w in t], dtype="<u4").tobytes() for t in texts]
    slots = orderminhash._slots(seqs)
    hopeful = orderminhash._hopeful(slots, slots, 0.8)
    own = [orderminhash.Shingled(s) for s in seqs]
    similar = {(i, j) for i in range(len(own)) for j in range(len(own)) if orderminhash.alignment(own[i], own[j], 0.8) >= 0.8}
    assert len(similar) > len(own) and all(hopeful[i, j] for i, j in similar)
    assert not hopeful.all()
