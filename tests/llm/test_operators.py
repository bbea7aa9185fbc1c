"""The corpus operators against plain loops, on whole small tables and on fixtures of odd rows."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from stowage.llm import contamination, language, licenses, packing, personal, quality, substring, urls, vectors
from stowage.llm.components import connected_components
from stowage.llm.near import near_duplicates
from stowage.llm.queries import ORACLES, QUERIES
from stowage.plans.staging import stage
from tests.conftest import SMALL
from tests.llm import plain
from workloads.check import compare, connect

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, bucket int"


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(("ba", "ke", "li", "mo", "nu", "ra", "so", "ti")) for _ in range(rng.randint(1, 4)))
                    for _ in range(n))


LONG = prose(1, 30_000)
ODD = [
    (0, None, None, None, None), (1, "", "en", "a", 0), (2, " \t\n ", "en", "a", 4), (3, "one two", "en", None, 7),
    (4, "One\vTWO", None, "b", 7), (5, prose(2, 400), "en", "a", 1), (6, prose(2, 400).upper(), "en", "a", 1),
    (7, prose(2, 400), "fr", "a", 1), (8, prose(3, 60) + " " + prose(2, 400), "de", "b", 1), (9, LONG, "es", "b", 1),
    (10, "x " * 500, "en", "c", 1), (11, prose(4, 20) + " " + "x " * 120, "en", "c", 1), (12, prose(2, 49), "en", "c", 1),
    (13, LONG[:40_000] + " zz " + LONG[40_000:], "es", "b", 1), (14, "öß é 漢字 😀 " * 30, "xx", "d", 1),
    (15, "öß é 漢字 😀 " * 30, "xx", "d", 1), (16, "a b c d", "en", "d", 1), (17, "A b  c D", "en", "d", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return stage(spark.createDataFrame([(*r, "clash", 1) for r in ODD], SCHEMA), "odd")


@pytest.fixture(scope="module")
def none(spark):
    return stage(spark.createDataFrame([], SCHEMA), "none")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def pairs(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", ["odd", "docs"])
def test_repeats(request, name):
    rows = request.getfixturevalue(name)
    got = {r[0]: tuple(r)[1:] for r in substring.without_repeats(rows).collect()}
    assert got == plain.repeats(pairs(rows))


def test_repeats_of_runs_and_periods(spark):
    """Runs and repeated lines of every period, which give long stretches of equal symbols."""
    rows = [(10 * p + k, prose(p, 5 * k) + " " + " ".join(prose(100 + p, p) for _ in range(160 // p)) + " " + prose(p + k, 7))
            for p in (1, 2, 3, 5, 7, 13) for k in range(4)]
    got = {r[0]: tuple(r)[1:] for r in substring.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain.repeats(rows)


def test_repeats_keep_the_text(odd):
    for r in substring.without_repeats(odd, with_text=True).where("n_removed = 0").collect():
        assert r.kept_text == " ".join(plain.words(dict((a, b) for a, b, *_ in ODD)[r.doc_id]))


@pytest.mark.parametrize("name", ["odd", "docs"])
def test_near(request, name):
    rows = request.getfixturevalue(name)
    got = {r[0]: tuple(r)[1:] for r in near_duplicates(rows).collect()}
    assert got == plain.near(pairs(rows))


def test_near_from_a_lower_similarity(spark):
    """Pairs of a similarity from 0.80 to 0.85 are linked where 80 percent are asked for, and only there."""
    rows = []
    for i in range(60):
        base = prose(300 + i, 204).split()
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join([*base[:184], *prose(900 + i, 20).split()]))]
    alike = {len(plain.shingles(a) & plain.shingles(b)) / len(plain.shingles(a) | plain.shingles(b))
             for (_, a), (_, b) in zip(rows[::2], rows[1::2], strict=True)}
    assert 0.8 <= min(alike) and max(alike) < 0.85
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in near_duplicates(docs, percent=80).where("kept").collect()} == {2 * i for i in range(60)}
    assert near_duplicates(docs).where("kept").count() == 120


def test_near_group_without_a_centre(spark):
    """A chain of texts, each near only to its neighbours, and a null id that is linked with nothing."""
    base = prose(9, 300).split()
    rows = [(i, " ".join(base[4 * i:4 * i + 120])) for i in range(20)] + [(None, " ".join(base[:120]))]
    got = {r[0]: tuple(r)[1:] for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = plain.near(rows[:-1])
    assert {k: v for k, v in got.items() if k is not None} == want
    assert got[None] == (116, None, True)


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 440)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = plain.components({x for a, b in links for x in (a, b)}, links)
    assert got == {k: v for k, v in want.items() if any(k in (a, b) and a != b for a, b in links)}


PRIVATE = [
    "write to a.b%c+d@x-y.example.org. or @no or a@b or c@d.e@f.g", "10.0.0.1 and 256.1.1.1 then 1.2.3.4.5.6.7.8 and 0255.000.1.01",
    "card 4111 1111 1111 1111, bad 4111 1111 1111 1112; 4111-1111-1111-1111-0 and 123456789012345678901234567890",
    "+1 (555) 010-9999 call +12 or +4 (0)30/123456 and ++49 30 1234567", "IBAN GB82 WEST 1234 5698 7654 32 and GB83 WEST 1234 5698 7654 32",
    "my social security number is 078-05-1120 but the number of the part that I ordered 078-05-1121 is not", "9" * 6000 + "." + "9" * 5000 + ".1.2 " + "a" * 50_000 + "@",
    None, "", "😀 x@y.zz 😀 +1 234 567 890"]


def test_personal(spark, odd, none):
    rows = spark.createDataFrame(list(enumerate(PRIVATE)), "doc_id long, text string")
    for r in personal.find_personal(rows).collect():
        got = [(s.kind, s.start, s.stop) for s in r.spans]
        if r.doc_id != 6:
            assert [s for s in got if s[0] in personal.BASE_KINDS] == plain.base_spans(PRIVATE[r.doc_id])
        assert [s[0] for s in got if s[0] not in personal.BASE_KINDS] == {4: ["iban"], 5: ["ssn"]}.get(r.doc_id, [])
    assert personal.find_personal(odd).count() == len(ODD) and personal.find_personal(none).count() == 0


@pytest.mark.parametrize("number", [
    "GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "NO93 8601 1117 947",
    "MT84 MALT 0110 0001 2345 MTLC AST0 01S"])
def test_account_numbers_before_other_capitals(number):
    for before in ("", "IBAN ", "REF AB12 3456 7890 1234 "):
        for after in ("", " BIC ABCDEFGH", " BIC COBADEFFXXX", " USD 100", " 2024", " and", "."):
            start, stop = len(before), len(before) + len(number)
            assert (4, start, stop) in personal.added_spans(before + number + after)
            assert "<IBAN>" + after == personal.masked(before + number + after)[len(before):]
    two = f"{number} GB82 WEST 1234 5698 7654 32"
    assert [two[a:b] for _, a, b in personal.added_spans(two)] == [number, "GB82 WEST 1234 5698 7654 32"]
    assert personal.added_spans(f"{number[:2]}00{number[4:]} BIC") == []


def test_personal_on_documents(docs):
    texts = dict(pairs(docs))
    for r in personal.find_personal(docs).collect():
        assert [(s.kind, s.start, s.stop) for s in r.spans if s.kind in personal.BASE_KINDS] == plain.base_spans(texts[r.doc_id])


def test_redact(spark):
    rows = spark.createDataFrame([(1, "mail a@b.cc now", 15), (2, None, None), (3, "plain", 99)], "doc_id long, text string, n_chars long")
    assert [tuple(r) for r in personal.redact(rows).orderBy("doc_id").collect()] == [
        (1, "mail <EMAIL> now", 16), (2, None, None), (3, "plain", 99)]


@pytest.mark.parametrize("name", ["odd", "docs"])
def test_packing(request, name):
    from tokenizers import Tokenizer

    import public_tokenizers

    rows = request.getfixturevalue(name)
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack_documents(rows).collect()
    pieces = {}
    for doc, text in pairs(rows):
        ids = np.array([*coder.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids), 1024), len(ids)]
        for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            pieces[doc, n] = (a, b - a, zlib.crc32(ids[a:b].tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == pieces and len(got) == len(pieces)
    ends = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 1024
    assert len(ends) <= 1.01 * sum(r.length for r in got) / 1024 + 2


def test_special_tokens_and_other_spaces():
    from tokenizers import Tokenizer

    import public_tokenizers

    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ours = packing.ByteEncoder(packing.default_ranks())
    for text in ("a<|endoftext|> b  c\n\n d\t e \u00a0 f\u3000\u0085 g", "  lead", "trail  ", "don't  we'll\r\nx", "1 234.5 ---  é漢 "):
        assert ours.encode(text) == np.array(coder.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_plan_is_tight_and_complete():
    rng = random.Random(2)
    for _ in range(60):
        counts = {rng.randint(1, 64): rng.randint(1, 40) for _ in range(rng.randint(1, 30))}
        rows = packing.plan_sequences(counts, 64)
        fill, placed = {}, dict.fromkeys(counts, 0)
        for length, first, n, sequence, per, at in rows:
            assert first == placed[length]
            placed[length] += n
            for k in range(n):
                fill.setdefault(sequence + k // per, []).append((at + k % per * length, length))
        assert placed == counts
        for spans in fill.values():
            spans.sort()
            assert spans[0][0] == 0 and all(a + b == c for (a, b), (c, _) in zip(spans, spans[1:], strict=False))
            assert sum(spans[-1]) <= 64
        assert len(fill) <= -(-sum(a * b for a, b in counts.items()) // 64) * 11 / 9 + 1 + sum(
            n for s, n in counts.items() if s > 32)


def test_packing_of_nothing(none):
    assert packing.pack_documents(none).count() == 0


def test_quality(spark, docs, odd, none):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    model = quality.train(docs, labels)
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    right = [(got[i].predicted == q) for i, q in truth.items() if i in got]
    assert sum(right) / len(right) > 0.9
    assert quality.score(odd, model).where("score BETWEEN 0 AND 1").count() == len(ODD)
    assert quality.score(none, model).count() == 0
    blank = quality.train(none, labels.limit(0))
    assert {r.score for r in quality.score(odd, blank).collect()} == {0.5}


def test_interactions_in_linear_time():
    rng = np.random.default_rng(0)
    model = quality.Model(0.3, rng.normal(size=quality.WIDTH), rng.normal(size=(quality.WIDTH, quality.FACTORS)))
    columns, values = np.array([3, 8, 100, 2050]), np.array([0.5, 1.0, -2.0, 0.25])
    want = 0.3 + model.linear[columns] @ values + sum(
        model.factors[columns[i]] @ model.factors[columns[j]] * values[i] * values[j] for i in range(4) for j in range(i))
    assert quality.decision(model, quality.Rows(1, np.zeros(4, int), columns, values))[0] == pytest.approx(want)


def test_language(docs, odd, none):
    got = {r.doc_id: r for r in language.identify_documents(docs).collect()}
    assert all(r.kept and r.language == r.declared for r in got.values())
    model = language.train(docs)
    rows = {r.doc_id: r for r in language.identify(odd, model, "doc_id", *_columns()).collect()}
    assert len(rows) == len(ODD) and not any(rows[i].kept for i in (0, 1, 2))
    assert language.identify(none, model, "doc_id", *_columns()).count() == 0


def _columns():
    from pyspark.sql import functions as F

    return F.col("text"), F.col("lang"), F.col("source"), F.lit(None)


def test_witnesses_decide_short_pages(spark, docs):
    model = language.train(docs)
    pages = [(i, f"http://h{i % 2}.example.net/{'fr' if i % 2 else 'de'}/{i}", f"<html lang='{'fr' if i % 2 else 'de'}'><p>{t}</p>")
             for i, t in enumerate(["le la des une tion", "der die ung lich"] * 0 + [
                 ("La tion des une et la mentre" if i % 2 else "Der ung und die lich enver") for i in range(40)])]
    pages += [(40, "http://h1.example.net/fr/x", "<html lang=fr>e"), (41, None, None), (42, "no address", "<b>")]
    got = {r.page_id: r for r in language.identify_pages(spark.createDataFrame(pages, "page_id long, url string, html string"), model).collect()}
    assert got[40].language == "fr" and got[1].language == "fr" and got[0].language == "de"
    assert not got[41].kept and not got[42].kept


def vectors_by_hand(rows):
    ids = [r[0] for r in rows]
    n, links = dict.fromkeys(ids, 0), []
    for x in range(len(rows)):
        for y in range(x):
            (i, v, a), (j, w, b) = rows[x], rows[y]
            if a is None or a != b or not v or not w or len(v) != len(w) or any(
                    c is None or not np.isfinite(c) for c in (*v, *w)):
                continue
            v, w = (np.array(z, np.float32).astype(float) for z in (v, w))
            if v.any() and w.any() and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.93:
                n[i] += 1
                n[j] += 1
                links.append((i, j))
    part = plain.components(ids, links)
    return {i: (n[i], part[i], part[i] == i) for i in ids}


def test_vectors(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + rng.normal(size=16) * (0.1 + 0.3 * (i % 4))).tolist(), i % 3) for i in range(300)]
    rows += [(300 + i, rows[5][1], 2) for i in range(30)] + [(340, [2 * x for x in rows[5][1]], 2)]
    rows += [(400, None, 1), (401, [], 1), (402, [0.0] * 16, 1), (403, [float("nan")] * 16, 1), (404, [float("inf")] + [1.0] * 15, 1),
             (405, [None] + [1.0] * 15, 1), (406, [1.0] * 16, None), (407, [1.0] * 16, None), (408, [1.0] * 3, 1), (409, [1.0, 1.0, 1.1], 1)]
    found = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    got, want = {r[0]: tuple(r)[1:] for r in found}, vectors_by_hand(rows)
    assert got == want and sum(v[0] for v in want.values()) > 1000


def test_vectors_keep_their_own_type(spark):
    """Doubles that floats can't tell apart at the threshold, or can't hold, and whole numbers."""
    turn, tiny = np.arccos(0.93), 1e-12
    rows = [(i, [float(np.cos(turn + e)), float(np.sin(turn + e))], 7) for i, e in enumerate((tiny, -tiny))] + [(2, [1.0, 0.0], 7)]
    rows += [(10, [1e200, 2e200, 3e200], 1), (11, [1e-200, 2e-200, 3e-200], 1), (12, [3e200, -2e200, 0.0], 1)]
    found = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {r[0]: tuple(r)[1:3] for r in found} == {0: (1, 0), 1: (2, 0), 2: (1, 0), 10: (1, 10), 11: (1, 10), 12: (0, 12)}
    whole = spark.createDataFrame([(1, [2**24, 1], 1), (2, [2**24 + 1, 1], 1), (3, [0, 5], 1)], "vec_id long, embedding array<long>, label int")
    assert {r[0]: r[1] for r in vectors.near_vectors(whole).collect()} == {1: 1, 2: 1, 3: 0}


def test_vectors_of_many_lengths_and_repeated_ids(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=1 + i % 40).tolist(), i % 2) for i in range(600)]
    rows += [(1000 + i, (rng.normal(size=5) * 0.2 + 1).tolist(), 0) for i in range(400)]
    found = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert {r[0]: tuple(r)[1:] for r in found} == vectors_by_hand(rows)
    twice = spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (4, [0.0, 1.0], 1)],
                                  "vec_id long, embedding array<float>, label int").selectExpr("*", "'clash' AS h1")
    assert sorted(tuple(r) for r in vectors.near_vectors(twice).collect()) == [(1, 2, 1, True)] * 3 + [(4, 0, 4, True)]


@pytest.mark.parametrize("rank, dims", [(3, 64), (4, 128), (6, 384)])
def test_vectors_of_low_rank(spark, rank, dims):
    """No link across list borders is lost where the vectors fill few dimensions."""
    rng = np.random.default_rng(rank)
    x = (rng.normal(size=(1200, rank)) @ rng.normal(size=(rank, dims))).astype(np.float32)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    found = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    unit = x.astype(float) / np.sqrt((x.astype(float) ** 2).sum(axis=1))[:, None]
    near = unit @ unit.T >= 0.93
    part = plain.components(range(len(x)), [(i, j) for i, j in np.argwhere(near).tolist() if i < j])
    assert near.sum() > 2 * len(x)
    assert {r[0]: tuple(r)[1:] for r in found} == {i: (int(near[i].sum()) - 1, part[i], part[i] == i) for i in range(len(x))}


def test_no_vectors(spark):
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_urls(spark):
    rows = [
        (1, "http://WWW.Example.COM/en/x?q#f", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
        (2, "https://m.example.com/en/", "m.example.com", "/en/", "example.com/en/", "block"),
        (3, "https://xexample.com/en/1", "xexample.com", "/en/1", "com/", "allow"),
        (4, "ftp://a.net/es/9?x", "a.net", "/es/9", "net/es/", "block"), (5, "x://net/fr/", "net", "/fr/", "net/fr/", "block"),
        (6, "http://spam-farm.example.org/en/7", "spam-farm.example.org", "/en/7", None, "block"),
        (7, "http://library.example.org/en/7", "library.example.org", "/en/7", None, "allow"),
        (8, None, "", "", None, None), (9, "", "", "", None, None), (10, "no scheme/com/", "", "", None, None),
        (11, "a://b?c/d", "b", "", None, None), (12, "a://É.COM#x://y", "É.com", "", None, None)]
    weights = urls.train(spark.createDataFrame(list(urls.LABELLED), "label int, url string"))
    got = urls.judge_urls(spark.createDataFrame([r[:2] for r in rows], "page_id long, url string"), *weights)
    told = {r.page_id: r for r in got.collect()}
    for page, _, host, path, rule, verdict in rows:
        r = told[page]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict in ("allow", "block") and verdict in (None, r.verdict)


def test_contaminated(spark, odd, none):
    items = [(1, prose(2, 400)[:300].rsplit(" ", 1)[0]), (2, prose(50, 30)), (3, None), (4, ""), (5, "one two"), (6, prose(1, 9000)[3000:3400])]
    listed = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_item, r.n_found) for r in contamination.contaminated(odd, listed).collect()}
    want = {}
    for i, text in pairs(odd):
        for j, item in items:
            own, of = plain.shingles(text), plain.shingles(item)
            if of and 10 * len(own & of) >= 8 * len(of):
                want[i, j] = (len(of), len(own & of))
    assert got == want and {j for _, j in want} == {1, 5, 6}
    assert contamination.contaminated(none, listed).count() == 0
    assert contamination.contaminated(odd, listed.limit(0)).count() == 0


def test_contaminated_among_repeats(spark):
    """Items in text that repeats a word, a phrase or a line, and items that repeat themselves."""
    rng, items, texts = random.Random(6), [], []
    for i in range(400):
        filler = " ".join(prose(7000 + i, (1, 2, 4, 9)[i % 4]).split() * 400).split()
        item = prose(6000 + i, rng.choice((30, 44, 80, 104))).split()
        if i % 5 == 0:
            item[len(item) // 2:len(item) // 2] = filler[:60]
        at = rng.randint(0, 300)
        items.append((i, " ".join(item)))
        texts.append((i, " ".join([*filler[:at], *item, *filler[at:400]])))
    found = contamination.contaminated(spark.createDataFrame(texts, "doc_id long, text string").repartition(4),
                                       spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id): (r.n_item, r.n_found) for r in found.collect()}
    sets = {i: plain.shingles(t) for i, t in items}
    assert got == {(i, i): (len(sets[i]), len(sets[i])) for i, _ in items}


def test_licenses(spark, odd, none):
    text = [licenses.TEMPLATES["mit"].replace("person", "body"), "x " * 300 + licenses.TEMPLATES["gpl-3.0-line"].upper() + " y" * 90,
            licenses.TEMPLATES["mit"][:200], None, ""]
    rows = spark.createDataFrame(list(enumerate(text)), "doc_id long, text string")
    got = {(r.doc_id, r.license) for r in licenses.licenses(rows).collect()}
    assert got == {(0, "mit"), (1, "gpl-3.0-line")}
    assert licenses.licenses(odd).count() == 0 and licenses.licenses(none).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    verdict = compare(spark, connect(SMALL), SMALL, QUERIES[name], ORACLES[name])
    assert verdict.startswith("ok"), verdict
