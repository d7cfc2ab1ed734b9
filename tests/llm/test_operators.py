"""Small fixtures of the operators: planted cases against brute force, and empty, null, repeated and odd rows."""

import hashlib
import re
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from treelink.llm import queries
from treelink.llm.decontaminate import decontaminate
from treelink.llm.language import identify, learn_trigrams
from treelink.llm.line_dedup import dedup_lines
from treelink.llm.near_join import jaccard_groups, keep_one_per_group
from treelink.llm.packing import binary_lengths, pack_power_of_two
from treelink.llm.pii import replace_pii, surrogates
from treelink.llm.substring_dedup import remove_repeated
from treelink.llm.toxicity import learn_lexicon, score_toxicity
from treelink.llm.vectors import coarse, search
from treelink.llm.warc_zip import directory, round_trip

SCHEMA = "doc_id long, text string, lang string, n long"
WORDS = [f"w{i}" for i in range(400)]


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", 1) for i, t in texts], SCHEMA)


ODD = [(1, None), (2, ""), (3, "one"), (3, "one"), (None, "lost"), (4, " ".join(WORDS * 30))]


@pytest.mark.parametrize("rows", [[], ODD])
def test_odd_rows(spark, rows):
    d = docs(spark, rows)
    bench = spark.createDataFrame([(1, "one"), (2, None)], "item_id long, text string")
    assert decontaminate(d, bench).count() == len(rows)
    assert decontaminate(d, bench.limit(0)).count() == len(rows)
    assert dedup_lines(d).count() == len(rows)
    assert jaccard_groups(d).count() == len(rows)
    assert remove_repeated(d).count() == len(rows)
    assert replace_pii(d, "k").count() == len(rows)
    assert score_toxicity(d, learn_lexicon(d, spark.createDataFrame([], "doc_id long, toxic int"))).count() == len(rows)
    assert pack_power_of_two(d, queries.tokenizer_path()).select("doc_id").distinct().count() == len({i for i, _ in rows})


def test_decontaminate(spark):
    d = docs(spark, [(1, "A " + " ".join(WORDS[:12]) + " b"), (2, " ".join(WORDS[:9])), (3, "x tiny item y")])
    bench = spark.createDataFrame([(7, " ".join(WORDS[:11])), (8, "Tiny, ITEM")], "item_id long, text string")
    got = {r.doc_id: (r.n_words, list(r.hits), list(r.item_ids)) for r in decontaminate(d, bench).collect()}
    assert got == {1: (14, list(range(1, 12)), ["7"]), 2: (9, [], []), 3: (4, [1, 2], ["8"])}


def test_lines(spark):
    d = docs(spark, [(1, "a\nb\n\nc"), (2, "x\na\nb\ny"), (3, "a\nz")])
    got = {r.doc_id: (r.text, r.n_removed) for r in dedup_lines(d).collect()}
    assert got == {1: ("a\nb\n\nc", 0), 2: ("x\ny", 2), 3: ("a\nz", 0)}


def by_lines(rows):
    """Plain Python: {doc_id: (text, n_removed)} for distinct doc_ids, runs of two lines and single lines of 50 words; a copy that overlaps the first one isn't a later one."""
    seen, out = {}, {}
    full = {d: [(i, x.strip(" ")) for i, x in enumerate(t.split("\n")) if x.strip(" ")] for d, t in rows if t is not None}
    for d, t in sorted(rows):
        if t is None:
            out[d] = (None, 0)
            continue
        gone = set()
        for k, (i, x) in enumerate(full[d]):
            runs = [full[d][k : k + 2]] if k + 1 < len(full[d]) else []
            runs += [[(i, x)]] if len(x.replace("\t", " ").split(" ")) - x.replace("\t", " ").split(" ").count("") >= 50 else []
            for run in runs:
                at = seen.setdefault(tuple(y for _, y in run), (d, k))
                gone |= {j for j, _ in run} if at[0] != d or at[1] + len(run) <= k else set()
        out[d] = ("\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone), len(gone))
    return out


def test_long_single_lines(spark):
    passage, short = " ".join(WORDS[:50]), " ".join(WORDS[:49])
    rows = [(1, f"a\n{passage}\nb"), (2, f"c\n {passage} \n\nd"), (3, passage), (4, f"{short}\ne"), (5, short), (6, f"{passage}\n{passage}"), (7, None)]
    got = {r.doc_id: (r.text, r.n_removed) for r in dedup_lines(docs(spark, rows)).collect()}
    assert got[2] == ("c\n\nd", 1) and got[3] == ("", 1) and got[5] == (short, 0) and got[6] == ("", 2)
    assert got == by_lines(rows)


def test_lines_of_documents(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: (r.text, r.n_removed) for r in dedup_lines(d).collect()}
    assert got == by_lines([(r.doc_id, r.text) for r in d.collect()])


def test_near_copies(spark):
    base = WORDS[:200]
    near = base[:-4] + ["new"] * 4
    d = docs(spark, [(5, " ".join(base)), (2, " ".join(near)), (9, " ".join(base)), (1, " ".join(WORDS[200:]))])
    got = {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in jaccard_groups(d).collect()}
    assert got == {5: (2, 1, 2), 2: (2, 1, 1), 9: (2, 1, 2), 1: (1, 0, 1)}
    assert sorted(r.doc_id for r in keep_one_per_group(d).collect()) == [1, 2]


def test_substrings(spark):
    rng = np.random.default_rng(1)
    word = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    shared, whole = word(260), word(300)
    rows = [(1, word(90) + shared + word(300)), (2, word(500) + shared + word(10)), (3, whole), (4, whole), (5, word(199) * 1), (6, "ab" * 300)]
    got = {r.doc_id: (r.n_removed, r.n_spans, bytes(r.kept)) for r in remove_repeated(docs(spark, rows)).collect()}
    count, texts = {}, {i: t.encode() for i, t in rows}
    for t in texts.values():
        for i in range(len(t) - 199):
            count[t[i : i + 200]] = count.get(t[i : i + 200], 0) + 1
    for i, t in texts.items():
        cover = np.zeros(len(t), bool)
        for s in range(len(t) - 199):
            if count[t[s : s + 200]] > 1:
                cover[s : s + 200] = True
        assert got[i] == (int(cover.sum()), int((np.diff(np.r_[0, cover.astype(int)]) == 1).sum()), bytes(np.frombuffer(t, np.uint8)[~cover]))


def test_surrogates(spark):
    text = "Mail jo@x.org or JO@X.ORG, call +1 (771) 555-1655, card 4111111111111111, host 10.1.2.3. Frau Berta met Mr. Hugo."
    r = replace_pii(docs(spark, [(1, text), (2, "again jo@x.org")]), "k").collect()
    a, b = sorted(r, key=lambda x: x.doc_id)
    assert a.n_entities == 7 and not any(x in a.text for x in ("jo@", "JO@", "771", "4111111111111111", "10.1.2.3", "Berta", "Hugo"))
    mail = b.text.split()[1]
    assert mail in a.text and mail.upper() in a.text and mail.endswith(".org")


def test_secrets_in_capitals(spark):
    low = "9233a8ecf7c5b09fe5949719b6b82bc439e9329b"
    r = replace_pii(docs(spark, [(1, f'TOKEN = "{low.upper()}" or {low}'), (2, f"mixed {low[:20].upper()}{low[20:]}")]), "k").collect()
    a, b = sorted(r, key=lambda x: x.doc_id)
    up, down = a.text.split()[2].strip('"'), a.text.split()[4]
    assert (a.n_entities, b.n_entities) == (2, 1) and list(a.kinds) == ["secret"]
    assert up == down.upper() and down == down.lower() and down != low and b.text == f"mixed {down}"


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


@pytest.mark.parametrize("card", ["4111 1111 1111 1111", "4111-1111-1111-1111", "3782 822463 10005", "5610 5910 8101 8250 008", "411 111 1111 111 111"])
def test_cards_in_groups(spark, card):
    phones = ["+49 171 1234 5678", "771 555-1655", "+1 (771) 555-1656"]
    plain = card.replace(" ", "").replace("-", "")
    texts = [f"card {card}.", f"plain {plain}", f"call {phones[0]} or {phones[1]} {phones[2]}", "pair 771 555-1655 772 555-1657", f"both 771 555-1655, {card}"]
    a, b, c, d, e = (x for x in sorted(replace_pii(docs(spark, list(enumerate(texts))), "k").collect(), key=lambda x: x.doc_id))
    new = a.text[5:-1]
    assert (a.n_entities, list(a.kinds), b.n_entities, list(b.kinds)) == (1, ["card"], 1, ["card"])
    assert [x if x in " -" else "0" for x in new] == [x if x in " -" else "0" for x in card] and new != card and "".join(filter(str.isdigit, new)) == b.text[6:]
    assert luhn(b.text[6:]) == luhn(plain)
    assert (c.n_entities, list(c.kinds)) == (3, ["phone"]) and (d.n_entities, list(d.kinds)) == (2, ["phone"])
    assert list(e.kinds) == ["card", "phone"] and e.text.endswith(new)


def test_four_groups_after_a_phone(spark):
    r = replace_pii(docs(spark, [(1, "771 555-1655 4111 1111 1111 1111"), (2, "4111 1111 1111 1111 771 555-1655")]), "k").collect()
    assert all((x.n_entities, list(x.kinds)) == (2, ["card", "phone"]) for x in r)


def test_whole_names(spark):
    texts = ["Mr John Smith came. Then Smith, Smith's friend and JOHN left.", "Dr. Anna von Berg-Meier and Prof Lind. Later Frau Berg saw Anna.", "Herr Dr. Karl Otto, Otto", "Госпожа Мария Петрова. Петрова ушла.", "John Smith"]
    got = {r.doc_id: r for r in replace_pii(docs(spark, list(enumerate(texts))), "k").collect()}
    for i, gone in enumerate([["John", "Smith", "JOHN"], ["Anna", "Berg", "Meier", "Lind"], ["Karl", "Otto"], ["Мария", "Петрова"]]):
        assert not any(x in got[i].text for x in gone)
    a = got[0].text.replace(",", "").replace("'s", "").replace(".", "").split()
    assert a[2] == a[5] == a[6] and a[1].upper() == a[9] and (got[0].n_entities, list(got[0].kinds)) == (4, ["he-latin"])
    b = got[1].text
    assert b.startswith("Dr. ") and " von " in b and list(got[1].kinds) == ["any-latin", "she-latin"] and b.split()[1] == b.split()[-1].rstrip(".") and b.split()[3].split("-")[0] == b.split()[-3]
    assert got[2].text.startswith("Herr Dr. ") and got[2].text.split()[3].rstrip(",") == got[2].text.split()[4] and list(got[3].kinds) == ["she-cyrillic"]
    assert got[4].text == "John Smith"


def test_more_names_than_the_lists_hold(spark):
    forms = spark.createDataFrame([("he-greek", f"ζ{chr(945 + i // 16)}{chr(945 + i % 16)}") for i in range(256)] + [("he-greek", f"ζζ{chr(945 + i // 16)}{chr(945 + i % 16)}") for i in range(256)], "kind string, canon string")
    new = [r.surrogate for r in surrogates(forms, "k").collect()]
    assert len(set(new)) == 512 and all("α" <= c <= "ώ" or c in "άέήίόύώ" for n in new for c in n)


def test_benchmark_stage_keeps_clean_rows_of_one_id(spark, monkeypatch):
    bench = spark.createDataFrame([(7, " ".join(WORDS[:10]))], "item_id long, text string")
    monkeypatch.setattr(corpus_pipeline, "table", lambda *_: bench)
    d = docs(spark, [(None, " ".join(WORDS[:12])), (None, "clean"), (4, " ".join(WORDS[:11])), (4, "fine"), (5, None)])
    got = corpus_pipeline.benchmark(spark, d, "").collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in got) == [("4", "fine"), ("5", "None"), ("None", "clean")]


def test_vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 16)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1020, [0.0] * 16), (1040, [float("nan")] * 16), (1060, [1.0])]
    got = search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).toPandas()
    x = x.astype(float)
    for q, g in got.groupby("query_id"):
        s = x @ x[q]
        s[q] = -9e9
        assert list(g.sort_values("rank")["vec_id"]) == list(np.lexsort((np.arange(300), -s))[:20])
    assert set(got["query_id"]) == set(range(0, 300, 20))


def test_vectors_with_copies(spark):
    """Three full blocks, a third of the rows copies of one vector: exact lists where copies are in them, and the recall of all."""
    rng = np.random.default_rng(4)
    n = 3 * 8192
    x = rng.normal(size=(n, 16)).astype(np.float32).astype(float)
    x[rng.choice(n, n // 3, replace=False)] = x[0] * 0.8
    d = spark.createDataFrame(list(zip(range(n), x.tolist())), "vec_id long, embedding array<double>")
    got = search(d, F.col("vec_id") % 500 == 0).toPandas()
    hits, with_copies = 0, 0
    for q, g in got.groupby("query_id"):
        s = (x * x[q]).sum(axis=1)
        s[q] = -9e9
        want, have = list(np.lexsort((np.arange(n), -s))[:20]), list(g.sort_values("rank")["vec_id"])
        hits += len(set(want) & set(have))
        if any((x[i] == x[0] * 0.8).all() for i in want):
            with_copies += 1
            assert have == want
    assert with_copies >= 10 and hits >= 0.98 * len(got)


def grouped(n, dims=16, groups=200):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(groups, dims))[rng.integers(0, groups, n)] + 0.25 * rng.normal(size=(n, dims))
    return x * np.exp(0.2 * rng.normal(size=(n, 1)))


def test_cells_of_grouped_vectors(spark):
    """Queries visit few cells where directions form groups, all rows where they don't, and get whole lists from tiny cells."""
    x = grouped(40_000)
    cells, visits = coarse(x[:20_000], x[::400], len(x), 20, 4.0, 0.995)
    assert len(cells.centres) == 78 and 3 * visits <= 78
    rng = np.random.default_rng(7)
    none, one = coarse(rng.normal(size=(20_000, 64)), rng.normal(size=(100, 64)), len(x), 20, 4.0, 0.995)
    assert len(none.centres) == 1 and one == 1
    x[:40] = -5 * x[40] + 0.01 * np.random.default_rng(8).normal(size=(40, 16))  # a far group of few rows
    got = search(spark.createDataFrame(list(zip(range(len(x)), x.tolist())), "vec_id long, embedding array<double>"), F.col("vec_id") % 500 == 0).toPandas()
    assert (got.groupby("query_id").size() == 20).all() and got["query_id"].nunique() == 80
    hits = 0
    for q, g in got.groupby("query_id"):
        s = x @ x[q]
        assert np.allclose(g["score"], s[g["vec_id"]]) and list(g.sort_values("rank")["vec_id"]) == list(g.sort_values(["score", "vec_id"], ascending=[False, True])["vec_id"])
        s[q] = -9e9
        hits += len(set(np.lexsort((np.arange(len(x)), -s))[:20]) & set(g["vec_id"]))
    assert hits >= 0.98 * len(got)


def test_vectors_of_other_layouts(spark):
    """The same lists however rows are dealt out."""
    rng = np.random.default_rng(6)
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(3000, 24)))], "vec_id long, embedding array<double>")
    got = [search(d.repartition(n), F.col("vec_id") % 100 == 0, sample_rows=500).orderBy("query_id", "rank").collect() for n in (1, 7)]
    assert got[0] == got[1]


def test_archives(spark, tmp_path):
    pages = spark.createDataFrame([(3, "http://a", "x é"), (1, "http://b", "x é"), (2, "http://c", None), (4, None, "")], "page_id long, url string, html string")
    got = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes) for r in round_trip(spark, pages).collect()}
    assert got == {1: ("response", None, 4), 3: ("revisit", 1, 4), 2: ("response", None, 0), 4: ("revisit", 2, 0)}
    assert round_trip(spark, pages.limit(0)).count() == 0


def test_zip64_directory(tmp_path, monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    p = tmp_path / "x.zip"
    with zipfile.ZipFile(p, "w") as z:
        z.writestr("a.warc", b"a" * 100)
        z.writestr("a.idx", b"b" * 50)
    data = p.read_bytes()
    members = directory(len(data), lambda at, n: data[at : at + n])
    assert [(name, data[at : at + n]) for name, at, n in members] == [("a.warc", b"a" * 100), ("a.idx", b"b" * 50)]
    assert struct.pack("<I", 0xFFFFFFFF) in data


def test_language(spark):
    d = spark.createDataFrame([(1, "der die und nicht ist", "de"), (2, "the and of that is", "en")], "doc_id long, text string, lang string")
    pages = spark.createDataFrame([(1, "http://x.de/", "<html><body>und nicht die</body>"), (2, "http://x.com/", "<html lang='en'>that of the"), (3, None, None)], "page_id long, url string, html string")
    got = {r.page_id: r.lang for r in identify(pages, *learn_trigrams(d)).collect()}
    assert got[1] == "de" and got[2] == "en" and len(got) == 3


def test_pieces():
    assert binary_lengths(2048 + 5, 2048) == [2048, 4, 1]
    assert hashlib.sha256(b"").hexdigest()[:4] == "e3b0"


FORMS = [
    ("Call +491711234567 or 7715551655 now.", ["491711234567", "7715551655"], ["phone"]),
    ("Call +4917112345678.", ["17112345678"], ["phone"]),
    ("ring 0049 171 1234567, 00491711234567 or 01711234567", ["1234567"], ["phone"]),
    ("write jörg@example.de or мария@почта.рф", ["jörg", "j", "мария", "example", "почта"], ["mail"]),
    ("token eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmNHl0w5N_XgL0n3I9PlFUP0THsR8U end", ["hbGciOiJIUzI1NiJ9", "zdWIiOiIxMjM0NTY3ODkwIn0", "dozjgNryP4J3jVmNHl0w5N_XgL0n3I9PlFUP0THsR8U"], ["key"]),
    ("Mr. Weber and Mrs. Weber met. Mrs Anna Weber too, Anna said.", ["Weber", "Anna"], ["he-latin", "she-latin"]),
]


@pytest.mark.parametrize("text, gone, kinds", FORMS)
def test_forms_of_personal_data(spark, text, gone, kinds):
    r = replace_pii(docs(spark, [(1, text)]), "k").first()
    assert list(r.kinds) == kinds and r.n_entities >= 1
    assert not any(re.search(rf"(?<![\w]){re.escape(g)}(?![\w])", r.text) for g in gone)
    assert len(r.text.split(" ")) == len(text.split(" "))


def test_family_names_are_shared(spark):
    words = replace_pii(docs(spark, [(1, "Mr. Weber and Mrs. Weber met. Mrs Anna Weber too.")]), "k").first().text.replace(".", "").split(" ")
    assert words[1] == words[4] == words[8]


def test_numbers_of_no_person_stay(spark):
    text = "epoch 1700000000 order 1234567890 price 7715551655.50 sum 77155516 id-7715551655 x7715551655"
    assert replace_pii(docs(spark, [(1, text)]), "k").first().text == text


def test_small_spaces_do_not_run_out(spark):
    """All forms of some types of few forms, whose surrogates may be none of them."""
    texts = [f"host ::{i:x} up" for i in range(10)] + [f"to {a}@{b}.de" for a in "abcdefghij" for b in "xy"]
    got = [r.text for r in replace_pii(docs(spark, list(enumerate(texts))), "k").collect()]
    assert len(set(got)) == len(texts) and not set(got) & set(texts)
