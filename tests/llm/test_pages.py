import random
import re
import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from termloom.llm import langid, lines, page_languages as pl, page_lines as pg, pages

EN = ["the", "a", "one", "our", "this"]
NOUN = ["river", "boat", "garden", "teacher", "window", "letter", "bridge", "table", "market", "story", "horse", "cloud", "engine", "forest", "island", "kettle"]
VERB = ["found", "painted", "followed", "measured", "opened", "carried", "repaired", "covered", "showed", "kept"]
NOUN += [a + b for a in ("sun", "rain", "snow", "moon", "fire", "hill", "sea", "corn") for b in ("light", "man", "side", "house", "field", "fall", "stone", "yard")]
FR = (["le", "un", "notre", "ce"], ["fleuve", "jardin", "maître", "pont", "marché", "cheval", "nuage", "moteur", "bateau", "château"], ["trouve", "répare", "montre", "couvre", "porte", "garde"])


def sentence(rng, fr=False):
    d, n, v = FR if fr else (EN, NOUN, VERB)
    return f"{rng.choice(d)} {rng.choice(n)} {rng.choice(v)} {rng.choice(d)} {rng.choice(n)} {'avec' if fr else 'with'} {rng.choice(d)} {rng.choice(n)}.".capitalize()


def paragraph(rng, n=5, fr=False):
    return " ".join(sentence(rng, fr) for _ in range(n))


def site(rng, host, page, body):
    menu = ["Home", "About us", "Contact", "Login", f"The {NOUN[host % len(NOUN)]}"]
    rng.shuffle(menu)
    name = f"Zarok{host}".rstrip("0123456789") + "x" * (host % 5)
    foot = [f"Copyright 20{page:02d} {name}", "All rights reserved.", "Print this page"]
    return "\n".join([f"Title of {page} by {host}", *menu, *body, "Most read", *(f"{sentence(rng)[:-1]}" for _ in range(4)), *foot]), len(menu)


@pytest.fixture(scope="module")
def crawl():
    rng = random.Random(7)
    rows, truth = [], {}
    for host in range(30):
        for page in range(3):
            body = [paragraph(rng), *["Background"] * (page == 1), paragraph(rng), "- 12 g the salt", "- 30 g the flour", paragraph(rng, 2)]
            text, m = site(rng, host, page, body)
            rid = f"r{host}-{page}"
            rows.append((rid, f"http://h{host}.example/{page}", bytearray(text.encode()), "en", 1))
            truth[rid] = set(range(2, 2 + m)) | set(range(2 + m + len(body), len(text.split("\n")) + 1))
    return rows, truth


SCHEMA = "record_id string, url string, content binary, lang string, host int"


@pytest.fixture(scope="module")
def samples(spark):
    rng = random.Random(1)
    rows = [(i, "fr" if i % 2 else "en", paragraph(rng, 6, i % 2 == 1)) for i in range(60)]
    return spark.createDataFrame(rows, "sample_id bigint, lang string, text string")


def letters(k):
    return "".join(chr(97 + int(d)) + "o" for d in str(k))


def spam(rng):
    word = rng.sample(NOUN, 3)
    return "Title\n" + "\n".join(f"cheap {rng.choice(word)}" for _ in range(60))


def test_furniture_and_spam(spark, crawl, samples):
    rows, truth = crawl
    rng = random.Random(2)
    odd = [("s1", "http://h1.example/s", bytearray(spam(rng).encode()), "en", 1), ("s2", None, bytearray(("T\n" + " | ".join(["buy boat"] * 40)).encode()), None, 1),
           ("s3", "http://h2.example/s", bytearray(("T\n" + "\n".join(f"http://a{k}.example/x" for k in range(30))).encode()), "en", 1),
           ("s4", "http://h3.example/s", bytearray(("T\n" + "\n".join("Boat sale boat! Cheap boat sale boat near boat. Sale boat, cheap boat." for _ in range(9))).encode()), "en", 1)]
    empty = [("e1", "http://h1.example/e", None, "en", 1), ("e2", "http://h1.example/e", bytearray(), None, 1), ("e3", None, bytearray(b"\n\n"), "en", 1),
             ("e4", "http://h1.example/f", bytearray(b"T\n\xff\xfe broken bytes here."), "en", 1), (None, "x", bytearray(b"T\nA b c d e."), "en", 1),
             ("long", "http://h1.example/l", bytearray(("T\n" + " ".join(f"The {letters(k)} {letters(k * 31 + 7)} a {letters(k * 17 + 5)}." for k in range(20000))).encode()), "en", 1)]
    df = spark.createDataFrame(rows + odd + empty + rows[:3] + [(*odd[0][:4], 2)], SCHEMA)
    got = pages.read_pages(df, samples)
    assert {r["record_id"] for r in pages.spam_records(got).collect()} == {"s1", "s2", "s3", "s4"}
    found = {}
    for r in pages.boilerplate(got).collect():
        found.setdefault(r["record_id"], []).append(r["line_no"])
    assert all(len(v) == len(set(v)) for v in found.values()) and not {"s1", "s2", "s3", "e1", "e2", "e3"} & set(found)
    right = sum(len(set(found.get(k, [])) & v) for k, v in truth.items())
    said = sum(len(found.get(k, [])) for k in truth)
    assert right / sum(map(len, truth.values())) > 0.97 and right / said > 0.97
    main = {r["record_id"]: r["text"] for r in pages.main_text(got, df).collect()}
    assert "Background" in main["r3-1"] and "Print this page" not in main["r3-1"] and "long" in main
    assert pages.read_pages(df.limit(0), samples).count() == 0


def test_paths_and_shapes():
    assert pg.path("- 12.3.2020 14:05 #77") == pg.path("1.4.19 1:2 #3") and pg.path("Mail a.b@c.de 5") == pg.path("Mail x@y.z 71")
    same = lambda a, b: set(pg.forms(a)[1:]) & set(pg.forms(b)[1:])
    assert same("Follow Zarok Bix", "Follow Anna") and same("Zarok & Bix stores small files.", "Anna stores small files.")
    assert same("Posted by Ann in the news", "Posted by Bob Lee in the news") and not same("Follow Zarok", "Print Zarok")
    assert not same("Zarok, stores files.", "Zarok stores files.")
    assert lines.label(" EN-gb ") == "en" and lines.label("deu") == "de" and lines.label("??") is None and lines.label(None) is None and lines.label("xx") is None
    p = pg.PageLines(["T\na | b - c\nso \"x.\"\r\n\n 黑龙江水 \nOne two. Three four", "", "U"])
    assert p.page.tolist() == [0, 0, 0, 0, 0, 2] and p.number.tolist() == [1, 2, 3, 5, 6, 1]
    assert p.pieces.tolist() == [1, 3, 1, 1, 2, 1] and p.ends.tolist() == [False, False, True, False, False, False]
    assert p.weight[:p.lines].tolist() == [1, 5, 2, 2, 4, 1]
    assert pg.PageLines([]).lines == 0 and pg.PageLines(["", "\n \n"]).lines == 0


@settings(max_examples=60)
@given(st.lists(st.text("ab A.\n|-5@黑龙\t", max_size=60), max_size=5))
def test_pages_are_looked_at_one_by_one_or_together(texts):
    """No page has any influence on how another one looks."""
    both = pg.PageLines(texts)
    page, path, counts = pages.page_votes(both)
    for i, t in enumerate(texts):
        one = pg.PageLines([t])
        mine = both.page == i
        assert one.number.tolist() == both.number[mine].tolist() and one.weight[:one.lines].tolist() == both.weight[:both.lines][mine].tolist()
        _, path1, counts1 = pages.page_votes(one)
        assert path1.tolist() == path[page == i].tolist() and counts1.tolist() == counts[page == i].tolist()


def test_letters_are_looked_at_in_narrow_arrays():
    """All letters have some bytes each in memory, not an array of long numbers for every question asked of them (84 bytes a letter)."""
    text = "\n".join(["Home | News | About us", "Mail anna@b.de 12.3.2020", *["So small files are stored there. And Zarok Bix says 12 of them, too."] * 40])
    texts = [text] * 100
    pg.PageLines(texts)
    tracemalloc.start()
    try:
        pg.PageLines(texts)
        assert tracemalloc.get_traced_memory()[1] < 60 * len(text) * len(texts)
    finally:
        tracemalloc.stop()


@given(st.text("ab \n\t\x1c\u3000.!?。！？", max_size=30))
def test_sentences_end_at_marks(text):
    ends = re.compile(r"(?:(?<=[.!?])\s+|(?<=[。！？])\s*|\n+)")
    assert langid.sentences(text) == [s.strip() for s in ends.split(text) if s.strip()]


@given(st.lists(st.booleans(), min_size=1, max_size=12))
def test_next_and_last_place_that_counts(skip):
    every, skip = np.arange(len(skip)), np.array(skip)
    assert pg._first_at(np.arange(len(skip) + 1), skip).tolist() == [*(pg._next(~skip)[:-1].tolist()), len(skip)]
    assert pg._final_at(every, skip).tolist() == pg._last(~skip).tolist()


def test_gaps():
    assert pg.gaps(np.array([0, 0, 0, 1, 1]), np.array([7, 8, 7, 7, 7])).tolist() == [0, 0, 2, 0, 1]


def test_language_model_on_held_out_sentences():
    rng = random.Random(3)
    model = langid.train([("fr" if i % 2 else "en", paragraph(rng, 4, i % 2 == 1)) for i in range(40)])
    test = [("fr" if i % 2 else "en", sentence(rng, i % 2 == 1)) for i in range(200)]
    p = model.log_probabilities(model.logits([s for _, s in test]))
    right = [model.languages[k] == lang for k, (lang, _) in zip(p.argmax(1), test)]
    assert sum(right) >= 198 and abs(sum(__import__("math").exp(x) for x in p[0]) - 1) < 1e-4
    assert model.logits(["", "x"]).shape == (2, 2)
    assert langid.smooth(p[:1]).tolist() == [int(p[0].argmax())]


def test_labels_and_mixed_records(spark, samples):
    rng = random.Random(4)
    en, fr = (lambda n: paragraph(rng, n)), (lambda n: paragraph(rng, n, True))
    pages_ = {"ok": (en(6), "EN"), "ok3": (fr(6), " fra "), "wrong": (fr(6), "en"), "none": (en(6), None), "blank": (en(6), " "), "junk": (en(6), "utf-8"),
              "mixed": (en(6) + "\n" + fr(4), "en"), "quote": (en(6) + "\n" + fr(1) + "\n" + en(3), "en"), "empty": ("", None)}
    rows = [(k, f"http://{k}.example/", bytearray(f"{t.split('.')[0][:20]}\n{t}".encode()) if t else None, lab, 1) for k, (t, lab) in pages_.items()]
    found = pl.languages(spark.createDataFrame(rows + rows[:2], SCHEMA), samples)
    got = {(r["record_id"], r["lang"]) for r in pl.wrong_or_mixed(found).collect()}
    assert got == {("wrong", "fr"), ("none", "en"), ("blank", "en"), ("junk", "en"), ("mixed", "en"), ("mixed", "fr")}
    by = {r["record_id"]: r for r in found.collect()}
    assert "empty" not in by and 0.5 < by["ok"]["confidence"] <= 1 and [p["lang"] for p in by["mixed"]["passages"]] == ["en", "fr"]
    assert pl.languages(spark.createDataFrame(rows, SCHEMA).limit(0), samples).count() == 0
    assert {r["lang"] for r in pl.languages(spark.createDataFrame(rows, SCHEMA), samples.limit(0)).collect()} == {"und"}


def test_a_host_is_one_judge_whatever_its_labels(spark):
    """Ten hosts have a notice on each of their four pages, half of the labels missing or wrong: every host agrees fully."""
    rng = random.Random(5)
    labs = ["en", None, "fr", "en"]
    rows = [(f"j{host}-{page}", f"http://j{host}.example/{page}", bytearray(f"T\n{paragraph(rng)}\nSitemap\n{paragraph(rng)}".encode()), labs[page], 1)
            for host in range(10) for page in range(4)]
    rows += [(f"{r[0]}-again", r[1], r[2], "de", 1) for r in rows[:4]]  # a later capture under another label is no other page
    seen = []
    real = pages.kind
    try:
        pages.kind = lambda **x: seen.append(x) or real(**x)
        winners, of_host = pages.vote(spark.createDataFrame(rows, SCHEMA))
    finally:
        pages.kind = real
    assert winners[pg.path("Sitemap")] == pages.FURNITURE
    assert (10, 10, 10.0, 1.0) in [(x["h"], x["judges"], x["agree"], x["share"]) for x in seen]
    assert all(pg.path("Sitemap") in r["paths"] for r in of_host.collect()) and of_host.count() == 10


def _votes(text):
    _, path, counts = pages.page_votes(pg.PageLines([text]))
    return dict(zip(path.tolist(), counts.tolist()))


def test_vote_counters_are_bounded():
    a, b = pg.path("a"), pg.path("b")
    for n in (16_383, 32_767, 70_000):
        got = _votes("T\n" + "\n".join(["a | a"] * n))
        assert got[a] >> 48 == min(2 * n, 0x7FFF) and all(0 <= v < 1 << 63 for v in got.values())
    got = _votes("T\nb\n" + "\n".join(["Boat sale"] * 65_540))
    assert got[pg.path("Boat sale")] & 0xFFFF == 0x7FFF and got[b] & 0xFFFF == 1


def _read(winners, text, own=()):
    reader = pages.PageReader({pg.path(k): v for k, v in winners.items()}, frozenset(["the", "a"]))
    p, kinds = reader.read([text], np.zeros(1, np.int64), [np.array([pg.path(x) if isinstance(x, str) else x for x in own], np.int64)])
    return kinds.tolist()


def test_without_votes_nothing_is_furniture(crawl):
    rows, truth = crawl
    texts = [r[2].decode() for r in rows]
    p, kinds = pages.PageReader({}, frozenset(["the", "a"])).read(texts)
    assert (kinds == pages.SITES).sum() == 0
    winners = {int(k): pages.FURNITURE for k in (pg.TITLES, pg.ENTRIES)}
    assert (pages.PageReader(winners, frozenset(["the", "a"])).read(texts)[1] == pages.SITES).sum() > 8 * len(rows)


def test_recurrence_decides_key_words(monkeypatch):
    rng = random.Random(11)
    reader = pages.PageReader({}, frozenset(["the", "a"]))
    bodies = ["\n".join("Boat sale boat! Cheap boat sale boat near boat. Sale boat, cheap boat." for _ in range(9)),
              "\n".join(f"cheap {rng.choice(['boat', 'table', 'lamp'])}" for _ in range(60)), " ".join(["buy boat cheap lamp"] * 30)]
    texts = [f"T\n{b}" for b in bodies] + [f"T\n{paragraph(rng, 40)}"]
    assert pages.spam(*reader.read(texts)).tolist() == [True, True, True, False]
    monkeypatch.setattr(pages, "gaps", lambda group, term: np.zeros(len(term), np.int64))
    assert pages.spam(*reader.read(texts)).tolist() == [False] * 4


def test_long_notices_vote_and_are_known(spark, samples):
    """A paragraph that a host puts on each of its pages is furniture however long it is, and a page's own long text is not."""
    rng = random.Random(6)
    rows, notice = [], {}
    for host in range(12):
        notice[host] = paragraph(rng, 4 + host)  # 200 to 1,000 characters
        for page in range(4):
            rows.append((f"n{host}-{page}", f"http://n{host}.example/{page}", bytearray(f"T\n{paragraph(rng)}\n{notice[host]}\n{paragraph(rng, 9)}".encode()), "en", 1))
    assert min(map(len, notice.values())) > pg.LONG_LINE and max(map(len, notice.values())) > 500
    found = {r["record_id"]: r["furniture"] for r in pages.read_pages(spark.createDataFrame(rows, SCHEMA), samples).collect()}
    assert len(found) == 48 and all(v == [3] for v in found.values())
    voted = _votes(f"T\n{notice[0]}")
    assert pg.path(notice[0]) in voted and all(pg.path(f"{x}.") in voted for x in notice[0].rstrip(".").split(". "))


def test_known_pieces_count_wherever_they_stand():
    notices = {"All rights reserved.": 1, "Read our terms of use before you go on with the visit.": 1, "Please tell us what you think of the new pages.": 1}
    one, two, three = notices
    odd = "Zarok grew quietly."
    long_ = " ".join([odd, two, three, two])
    assert len(long_) > pg.LONG_LINE and len(f"{odd} {two}") <= pg.LONG_LINE
    body = paragraph(random.Random(8)) + " " + one
    T, F, P = pages.TITLE, pages.SITES, pages.PROSE
    assert _read(notices, f"T\n{long_}\n{odd} {two}\n{odd} {two} {odd}\n{body}") == [T, F, F, F, P]
    assert _read({}, f"T\n{long_}\n{odd} {two}\n{body}", own=[two, three]) == [T, F, F, P]  # the host's own paths alone
    glued = {"Accept all": 1, "Manage preferences": 1, two: 1}
    assert _read(glued, f"T\nAccept all Manage preferences {two}\nAccept all Zarok {odd}\n{body}")[1] == F


def test_generalised_paths_of_a_host_are_applied():
    body = paragraph(random.Random(9))
    name = pg.forms("Posted by Zarok")[-1]
    assert _read({}, f"T\n{body}\nPosted by Ann Lee\n{body}", own=[name]) == [pages.TITLE, pages.PROSE, pages.SITES, pages.PROSE]


def test_pages_without_url_vote_each(spark):
    rng = random.Random(10)
    rows = [(f"u{k}", None, bytearray(f"T\n{paragraph(rng)}\nPrint this page".encode()), "en", 1) for k in range(6)]
    winners, of_host = pages.vote(spark.createDataFrame(rows, SCHEMA))
    assert winners[pg.path("Print this page")] == pages.FURNITURE and of_host.count() == 0
    assert pages.vote(spark.createDataFrame(rows[:1] * 6, SCHEMA))[0] == {}  # equal pages vote once
