from __future__ import annotations

import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanforge.llm import html, langid, packing, pieces, quality, toxicity
from scanforge.llm.common import held_out

DOCS = "doc_id long, text string, lang string, score string, x int"


def words(rnd, n, syllables):
    return " ".join("".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 3))) for _ in range(n))


SYLLABLES = {"en": "the ing and ed th sh wh ea".split(), "de": "sch ung ei ch heit tz ver ö".split(), "fr": "eau que é oi eux tre ê".split(), "es": "ción ñ ado ll mente ar ó".split()}


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(1)
    return [(i, words(rnd, rnd.randint(30, 80), SYLLABLES[lang]), lang, "s", 1) for i in range(240) for lang in [list(SYLLABLES)[i % 4]]]


def test_language(spark, texts):
    odd = [(1000, None, "en", "s", 1), (1001, "", None, "s", 1), (1002, "123 456 !", "de", "s", 1), (None, texts[0][1], None, "s", 1), texts[3], (1003, texts[1][1] * 3000, None, "s", 1)]
    df = spark.createDataFrame([*texts, *odd], DOCS)
    rows = langid.identify_language(df, 150).collect()
    assert len(rows) == len(texts) + len(odd)
    by = {r["doc_id"]: r for r in rows}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (1000, 1001, 1002))
    assert by[None]["lang_pred"] == "en" and by[1003]["lang_pred"] == "de"
    good = [by[i]["lang_pred"] == lang for i, _, lang, *_ in texts if by[i]["held_out"]]
    assert sum(good) >= 0.95 * len(good) and all(0 <= r["score"] <= 1 for r in rows)


def test_language_without_labels(spark, texts):
    df = spark.createDataFrame([(*t[:2], None, *t[3:]) for t in texts[:9]], DOCS)
    assert {r["lang_pred"] for r in langid.identify_language(df).collect()} == {"und"}
    assert langid.identify_language(df.limit(0)).count() == 0


def test_language_against_loops(texts):
    x = np.stack([langid.features(t[1]) for t in texts[:120]])
    model = langid.train(x, [t[2] for t in texts[:120]])
    lang, score = model.predict([t[1] for t in texts[120:]])

    def choose(v, names, prefix):
        """One against one: the class with the most won duels, then the highest mean probability."""
        if len(names) == 1:
            return names[0], 1.0
        won, sure = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0)
        for i, a in enumerate(names):
            for b in names[i + 1 :]:
                w, slope = model.machines[prefix + a, prefix + b]
                p = 1 / (1 + math.exp(-max(-40, min(40, slope * (sum(float(s) * float(t) for s, t in zip(v, w)) + w[-1])))))
                won[a if p >= 0.5 else b] += 1
                sure[a] += p / (len(names) - 1)
                sure[b] += (1 - p) / (len(names) - 1)
        best = max(names, key=lambda n: (won[n], sure[n]))
        return best, sure[best]

    for t, got, s in list(zip(texts[120:], lang, score))[::6]:
        v = langid.features(t[1])
        fam, p = choose(v, sorted(model.families), "family ")
        want, q = choose(v, model.families[fam], "")
        assert got == want and abs(s - p * q) < 1e-6


def test_language_of_repeated_rows(spark, texts):
    df = spark.createDataFrame([*texts, *texts[:50]], DOCS)
    some = lambda d: sorted(map(str, langid.identify_language(d, 100).collect()))
    assert some(df.repartition(3)) == some(df.repartition(7, "text"))


def test_families():
    assert langid.family("de-AT") == "germanic" and langid.family("xx") == "xx"


def test_toxicity(spark):
    rnd = random.Random(2)
    docs, labels = [], []
    for i in range(700):
        w = words(rnd, 60, SYLLABLES["en"]).split()
        bad = i % 5 == 0
        for _ in range(4 if bad else 0):
            w[rnd.randrange(60)] = rnd.choice(["blockhead", "nincompoop", "scoundrels"])
        docs.append((i, " ".join(w), "en", "s", 1))
        labels.append((i, 1, int(bad)))
    docs += [(None, None, None, "s", 1), (5000, "", None, "s", 1), (5001, None, None, "s", 1), docs[0], (5002, docs[1][1] * 300, None, "s", 1)]
    df = spark.createDataFrame(docs, DOCS)
    lab = spark.createDataFrame([*labels, (3, 1, None), (None, 1, 1), labels[0]], "doc_id long, quality int, toxic int")
    rows = toxicity.classify_toxicity(df, lab).collect()
    assert len(rows) == len(docs) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    held = [(r["predicted"], int(r["doc_id"] % 5 == 0)) for r in rows if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 700]
    hit = [p for p, y in held if y]
    assert sum(hit) >= 0.95 * len(hit) and sum(p for p, y in held if not y) <= 0.01 * len(held)
    assert toxicity.classify_toxicity(df, lab.limit(0)).where("predicted = 1").count() == 0
    assert toxicity.classify_toxicity(df.limit(0), lab).count() == 0


def test_windows_cover_everything():
    data = toxicity.normal("Some Words, and a " + "verylong" * 50 + " one")
    assert "".join(w.decode()[: None if i == 0 else None].lstrip(" ") if i else w.decode() for i, w in enumerate(toxicity.windows(data))).replace(" ", "") == data.decode().replace(" ", "")
    assert toxicity.windows(toxicity.normal("")) == [b"  "]


def test_every_word_lies_within_a_window():
    rnd = random.Random(9)
    for _ in range(50):
        data = toxicity.normal(words(rnd, rnd.randint(1, 60), SYLLABLES["en"]))
        whole = [w for w in toxicity.both_windows(data) if w]
        assert all(any(b" " + word + b" " in w for w in whole) for word in data.split())


def test_dictionary_content():
    import zstandard

    samples = [f"word{i % 37} and more {i % 11} of it".encode() for i in range(3000)]
    trained = zstandard.train_dictionary(1024, samples).as_bytes()
    held = toxicity.content(trained)
    assert trained.endswith(held) and 8 <= len(held) < 1024 and set(held) <= set(b"".join(samples))


def test_toxic_scores_against_loops():
    rnd = random.Random(10)
    plain = [words(rnd, 50, SYLLABLES["en"]) for _ in range(300)]
    bad = [f"{words(rnd, 20, SYLLABLES['en'])} blockhead {words(rnd, 20, SYLLABLES['en'])} nincompoop {words(rnd, 5, SYLLABLES['en'])}" for _ in range(100)]
    model = toxicity.train(bad, plain)
    texts = [*bad[:20], *plain[:20], "", None, "a", "blockhead " * 500]
    for text, score in zip(texts, model.scores(texts)):
        data, saved = toxicity.normal(text), []
        starts = [0] + ([data.find(b" ", toxicity.WINDOW // 2)] if len(data) > toxicity.WINDOW and data.find(b" ", toxicity.WINDOW // 2) > 0 else [])
        for start in starts:
            rest = data[start:]
            while len(rest) > 1:
                end = len(rest) if len(rest) <= toxicity.WINDOW else rest.find(b" ", toxicity.WINDOW, toxicity.WINDOW + 24) + 1 or toxicity.WINDOW
                w, rest = rest[:end], b"" if end == len(rest) else rest[end - 1 :] if rest[end - 1 : end] == b" " else rest[end:]
                saved.append(len(model._compressor(model.ordinary).compress(w)) - len(model._compressor(model.toxic + model.ordinary).compress(w)))
        top = sorted(saved, reverse=True)[:5] + [0] * max(0, 5 - len(saved))
        many = sum(v >= 3 for v in saved)
        x = [*top, sum(saved) / len(saved), math.log(len(saved)), many / math.sqrt(len(saved)), many]
        z = sum((v - m) / s * w for v, m, s, w in zip(x, model.mean, model.scale, model.weights)) + model.weights[-1]
        assert abs(score - 1 / (1 + math.exp(-z))) < 1e-9
    assert min(model.scores(bad)) > max(model.scores(plain[:20]))


def test_held_out_is_a_third(spark):
    n = spark.range(3000).where(held_out("id")).count()
    import zlib

    assert n == sum(zlib.crc32(str(i).encode()) % 3 == 1 for i in range(3000))


def test_quality(spark, texts):
    rnd = random.Random(3)
    good = [(i, ". ".join(t[:60] for t in (t[1], t[1][60:120], t[1][120:])), None, "s", 1) for i, t in enumerate(texts)]
    junk = [(1000 + i, " ".join(w + rnd.choice(["###", "$$$", "%%%"]) for w in texts[i][1].split()), None, "s", 1) for i in range(40)]
    junk += [(2000 + i, " ".join([texts[i][1].split()[0]] * 80), None, "s", 1) for i in range(40)]
    odd = [(None, None, None, "s", 1), (3000, "", None, "s", 1), good[0], (3001, good[1][1] * 2000, None, "s", 1)]
    df = spark.createDataFrame([*good, *junk, *odd], DOCS)
    rows = {r["doc_id"]: r for r in quality.classify_quality(df, 250).collect()}
    assert np.mean([rows[d[0]]["keep"] for d in good]) > 0.95
    assert np.mean([rows[d[0]]["keep"] for d in junk]) < 0.1
    assert quality.classify_quality(df).count() == len(good) + len(junk) + len(odd)
    assert quality.classify_quality(df.limit(0)).count() == 0


def test_quality_against_loops(spark, texts):
    """Expectation and maximisation written out vote by vote, over all rows rather than over patterns."""
    rnd = random.Random(14)
    rows = [(i, t[1] if i % 3 else " ".join(w + rnd.choice(["###", "$$$"]) for w in t[1].split()), None, "s", 1) for i, t in enumerate(texts[:90])]
    all_votes = [quality.votes(r[1]) for r in rows]
    acc = [[[0.6, 0.3, 0.1], [0.3, 0.05, 0.65]] for _ in range(quality.LABELLERS)]
    prior = 0.8
    for turn in range(201):
        post = []
        for v in all_votes:
            good, bad = math.log(prior), math.log(1 - prior)
            for j, x in enumerate(v):
                if x >= 0:
                    good, bad = good + math.log(acc[j][1][x + 1]), bad + math.log(acc[j][0][x + 1])
            post.append(1 / (1 + math.exp(max(-40, min(40, bad - good)))))
        for j in range(quality.LABELLERS) if turn < 200 else ():
            for c in range(2):
                n = [1.0, 1.0, 1.0]
                for v, p in zip(all_votes, post):
                    n[v[j] + 1] += p if c else 1 - p
                acc[j][c] = [k / sum(n) for k in n]
        prior = min(0.99, max(0.01, (sum(post) + 1) / (len(post) + 2))) if turn < 200 else prior
    got = {r["doc_id"]: r["posterior"] for r in quality.classify_quality(spark.createDataFrame(rows, DOCS), 60).collect()}
    assert max(abs(got[i] - p) for i, p in enumerate(post)) < 1e-4


def test_label_model_finds_accuracies():
    rnd = np.random.default_rng(0)
    truth = rnd.random(20000) < 0.7
    acc = [0.9, 0.8, 0.7, 0.85]
    votes = np.stack([np.where(rnd.random(20000) < 0.3, -1, np.where(rnd.random(20000) < a, truth, ~truth).astype(int)) for a in acc], 1)
    pat, n = np.unique(votes, axis=0, return_counts=True)
    model = quality.fit_label_model(pat, n.astype(float))
    found = [model.accuracy[j, 1, 2] / model.accuracy[j, 1, 1:].sum() for j in range(4)]
    assert np.abs(np.array(found) - acc).max() < 0.03 and abs(model.prior - 0.7) < 0.03


def test_packing_invariants(spark):
    rnd = random.Random(4)
    docs = [(i, "w " * rnd.choice([1, 3, 50, 300, 511, 512, 513, 4095]), None, "s", 1) for i in range(400)]
    docs += [(900, None, None, "s", 1), (901, "", None, "s", 1), (902, "w " * 10000, None, "s", 1), docs[0], (None, "a b", None, "s", 1)]
    df = spark.createDataFrame(docs, DOCS)
    rows = packing.pack_documents(df, packing.count_words("text"), shard=100).collect()
    assert sum(r["n_tokens"] for r in rows) == sum(len((d[1] or "").split()) for d in docs)
    bins = {}
    for r in rows:
        if r["n_tokens"]:
            bins.setdefault((r["bin_id"], r["capacity"]), []).append((r["offset"], r["n_tokens"]))
        else:
            assert r["bin_id"] is None
    assert len({b for b, _ in bins}) == len(bins)
    for (_, cap), parts in bins.items():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= cap and all(at > c for c in packing.CAPACITIES if c < cap)
    assert sorted((r["piece"], r["start"], r["n_tokens"]) for r in rows if r["doc_id"] == 902) == [(0, 0, 4096), (1, 4096, 4096), (2, 8192, 1808)]
    assert packing.pack_documents(df.limit(0), packing.count_words("text")).count() == 0


def slow_pack(lengths, capacities, overhead):
    """Best fit by trying every open bin, and every capacity for a new one, one after the other."""
    todo, bins = sorted(lengths, reverse=True), []  # bins: [capacity, used], that changed last at the end
    while todo:
        n = todo.pop(0)
        fits = [b for b in bins[::-1] if b[0] - b[1] >= n]
        if fits:
            b = min(fits, key=lambda b: b[0] - b[1])
            bins = [x for x in bins if x is not b] + [[b[0], b[1] + n]]
            continue
        best = None
        for c in sorted(capacities):
            if c >= n:
                room, tokens = c - n, n
                for m in todo:  # the largest that still fit
                    if m <= room:
                        room, tokens = room - m, tokens + m
                best = min(best or (math.inf,), ((c + overhead) / tokens, c))
        bins.append([best[1], n])
    return sorted((min(c for c in capacities if c >= used), used) for _, used in bins)


def test_packing_against_brute_force():
    rnd = random.Random(12)
    for _ in range(60):
        lengths = [rnd.randint(1, 64) for _ in range(rnd.randint(1, 80))]
        bins, capacity, _ = packing.pack(np.array(lengths), (16, 32, 64), 3)
        used = np.bincount(bins, lengths).astype(int)
        assert sorted({b: (int(capacity[list(bins).index(b)]), int(used[b])) for b in set(bins.tolist())}.values()) == slow_pack(lengths, (16, 32, 64), 3)


def test_packing_does_not_follow_the_files(spark):
    rnd = random.Random(13)
    docs = [(rnd.choice([None, i, i // 3]), "w " * rnd.choice([0, 1, 3, 50, 300, 512, 4095, 4096, 9000]), None, "s", 1) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string, n string, shard string, piece int").repartition(2)
    some = lambda d: sorted(map(str, packing.pack_documents(d, packing.count_words("text"), shard=40).collect()))
    assert some(df) == some(df.repartition(13, "text")) == some(df.coalesce(1).orderBy(F.desc("doc_id")))


def test_packing_is_best_fit():
    b, c, _ = packing.pack(np.array([7, 5, 3, 2]), (8, 10), 0)
    # 7 opens 10, as 7 + 3 fill it; 5 opens 8, as 5 + 3 fill it; 3 goes where it fits exactly, 2 into what is left
    assert b.tolist() == [0, 1, 1, 0] and c.tolist() == [10, 8, 8, 10]
    assert packing.pack(np.array([3]), (4, 8))[1].tolist() == [4]


@pytest.fixture(scope="module")
def model():
    return pieces.load()


SAMPLES = ["", " ", "Hello world", "  two  spaces ", "日本語 テスト 😀\n\n\tx", "a" * 700 + "é", "ünïcödé\r\nline", "▁", "x y"]


def test_pieces_round_trip(model):
    for t, ids in zip(SAMPLES, model.encode(SAMPLES)):
        assert model.decode(ids) == t.replace("▁", " ")
    assert model.encode([None]) == [None]


def test_pieces_match_the_library(model):
    import sentencepiece

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def part(field, data):
        return varint(field << 3 | 2) + varint(len(data)) + data

    out, k = b"", 0
    for f, v in pieces.proto_fields(open(pieces.MODEL_PATH, "rb").read()):
        if f == 1:
            out += part(1, part(1, model.pieces[k]) + varint(2 << 3 | 5) + struct.pack("<f", model.scores[k]) + varint(3 << 3) + varint(int(model.kinds[k])))
            k += 1
        elif f == 2:
            spec = b""
            for g, w in pieces.proto_fields(v):
                w = 1 if g == 3 else w
                spec += varint(g << 3) + varint(w) if isinstance(w, int) else varint(g << 3 | 5) + w if g in (10, 15, 51) else part(g, w)
            out += part(2, spec)
        else:
            out += part(f, v)
    theirs = sentencepiece.SentencePieceProcessor(model_proto=out)
    rnd = random.Random(5)
    texts = [t for t in SAMPLES if t] + [words(rnd, 30, [*SYLLABLES["en"], *SYLLABLES["fr"], "quick", "fox", "\n"]) for _ in range(60)]
    for a, b in zip(model.encode(texts), theirs.encode(texts)):
        # equal, or another path of the same score
        assert list(a) == list(b) or abs(model.scores[list(a)].sum() - model.scores[list(b)].sum()) < 1e-3


def test_both_ways_of_viterbi_agree(model):
    rnd = random.Random(6)
    segs = [s.encode() for s in {words(rnd, 1, SYLLABLES["es"]) + rnd.choice(["", "日", "😀x"]) for _ in range(200)}]
    for s, ids in zip(segs, model._many(segs)):
        one = model._one(s)
        assert one == ids or abs(model.scores[one].sum() - model.scores[ids].sum()) < 1e-6


def test_parts_change_nothing(model, monkeypatch):
    t = " ".join(f"word{i} x\n" for i in range(200)) + "y" * 600
    whole = model.encode([t, None, ""])
    monkeypatch.setattr(pieces, "PART", 50)
    model._cache.clear()
    again = model.encode([t, None, ""])
    assert (whole[0] == again[0]).all() and again[1] is None and again[2].size == 0


def test_piece_columns(spark, model):
    df = spark.createDataFrame([(1, "a b", None, "s", 1), (2, None, None, "s", 1), (3, "", None, "s", 1), (1, "a b", None, "s", 1)], DOCS)
    got = df.select("text", pieces.encode(spark, model).alias("ids")).select("text", "ids", pieces.decode(spark, model).alias("back")).collect()
    assert all(r["text"] == r["back"] for r in got)
    rep = pieces.coding_report(df, model).collect()
    assert [r["round_trip"] for r in rep] == [True, None, True, True] and pieces.coding_report(df.limit(0), model).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style></head><body><header>Site</header><div id="cookie-notice">We use cookies</div>
<nav><ul><li><a href=x>Home</a></ul></nav><main><article class="post"><header><h1>T &amp; x</h1></header><section><p>First para is long enough, really.</p><p>Second&nbsp;one.</section>
<section><p>Third part with words<br>line two</p><ul><li>one<li>two</ul><div class="related"><a href=a>Rel</a></div></section><div class="ad">Buy</div><form><input><label>Mail</label></form></article>
<aside>Side</aside><section id="comments"><p>Nice post, a very long comment that goes on and on and on and on and on for longer than all the article.</p></section></main><footer>F</footer><script>var t="</p>";</script></body></html>"""


def test_html():
    assert html.main_text(PAGE).split("\n") == ["T & x", "First para is long enough, really.", "Second one.", "Third part with words line two", "one", "two"]


@pytest.mark.parametrize("page,want", [(None, ""), ("", ""), ("just text", "just text"), ("<p>a<p>b", "a\nb"), ("<div><b>x</b> y</div><script>z", "x y"), ("a < b &lt; c", "a < b < c"), ("<p>cut &am", "cut &am"), ("<p>cut <b cl", "cut"), ("<!-- only -->", ""), ("<table><tr><td>1<td>2</table>", "1\n2")])
def test_html_odd(page, want):
    assert html.main_text(page) == want


def test_html_deep_and_long():
    assert html.main_text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    text = html.main_text("<article>" + "<p>word </p>" * 20000 + "</article>")
    assert text.count("word") == 20000


SENTENCE = "This sentence belongs to the article and says something at length, as articles do. "

# (page, text): furniture has no telling name, so that only density parts it from the article
PLAIN_PAGES = {
    "boxes": (
        "<body><div class='x1'><a href=a>One</a> <a href=b>Two</a> <a href=c>Three</a></div><div class='x2'><p>Buy this now.</p></div>"
        f"<div class='x3'><h2>Head</h2>{''.join(f'<p>{SENTENCE}{i}</p>' for i in range(5))}</div><div class='x4'><p>Imprint</p><a href=z>Contact us here</a></div></body>",
        ["Head", *[f"{SENTENCE}{i}" for i in range(5)]],
    ),
    "sections": (
        "<body><div><a href=a>Home</a><a href=b>News</a></div><div><section>" + "".join(f"<p>{SENTENCE}{i}</p>" for i in range(4)) + "</section><section>" + "".join(f"<p>{SENTENCE}{i}</p>" for i in range(4, 7)) + "</section></div><div>Small print</div></body>",
        [f"{SENTENCE}{i}" for i in range(7)],
    ),
    "heading beside": (
        f"<body><div><div><a href=a>Menu one</a> <a href=b>Menu two</a></div><h1>Title</h1><div>{''.join(f'<p>{SENTENCE}{i}</p>' for i in range(4))}</div><div><a href=q>More</a> <a href=r>Even more</a></div></div></body>",
        ["Title", *[f"{SENTENCE}{i}" for i in range(4)]],
    ),
    "in body": (f"<body><nav><a href=a>Home</a></nav>{''.join(f'<p>{SENTENCE}{i}</p>' for i in range(3))}<footer>F</footer></body>", [f"{SENTENCE}{i}" for i in range(3)]),
    "unlucky names": (
        f"<body><article><p>{SENTENCE}</p><div class='social-media-study'>A study.</div><blockquote class='alert'>A quote.</blockquote><p class='notice'>Noted.</p><div class='ad'>Buy</div><p>{SENTENCE}</p></article></body>",
        [SENTENCE, "A study.", "A quote.", "Noted.", SENTENCE],
    ),
    "two articles": (f"<body><main><article><h2>A</h2><p>{SENTENCE}</p></article><article><h2>B</h2><p>{SENTENCE}</p><p>{SENTENCE}</p></article></main><div>Away</div></body>", ["A", SENTENCE, "B", SENTENCE, SENTENCE]),
    "one paragraph": (f"<body><div><a href=a>x</a></div><article><p>{SENTENCE}</p></article><div>tiny</div></body>", [SENTENCE]),
    "links in prose": (f"<body><div id=q>{''.join(f'<p>{SENTENCE}<a href=x>see there</a></p>' for _ in range(3))}<ul><li>first of the points</li><li>second of them</li></ul></div><div><a href=1>a b c</a></div></body>", [*[f"{SENTENCE}see there"] * 3, "first of the points", "second of them"]),
}


@pytest.mark.parametrize("name", PLAIN_PAGES)
def test_html_by_density(name):
    page, want = PLAIN_PAGES[name]
    assert html.main_text(page).split("\n") == [w.strip() for w in want]


def test_html_choice_decides():
    """The same pages without a choice hold their furniture too."""
    differ = 0
    for page, want in PLAIN_PAGES.values():
        root = html.parse(page)
        html._measure(root)
        differ += html._text(root).split("\n") != [w.strip() for w in want]
    assert differ >= 5


def slow_counts(node):
    """(characters, tags, characters in links, tags of links) below a node, by plain recursion."""
    c = t = lc = lt = 0
    for x in node.children:
        if isinstance(x, str):
            c += sum(not ch.isspace() for ch in x)
        elif not x.dropped:
            a, b, d, e = slow_counts(x)
            c, t, lc, lt = c + a, t + b + 1, lc + d, lt + e + (x.tag == "a")
    return c, t, c if node.tag == "a" else lc, lt


def test_html_densities_against_recursion():
    rnd = random.Random(8)

    def some(depth):
        if not depth or rnd.random() < 0.2:
            return words(rnd, rnd.randint(1, 12), SYLLABLES["en"])
        tag = rnd.choice(["div", "p", "a", "span", "li", "section"])
        return f"<{tag}>" + "".join(some(depth - 1) for _ in range(rnd.randint(1, 4))) + f"</{tag}>"

    for _ in range(40):
        root = html.parse("<body>" + "".join(some(4) for _ in range(3)) + "</body>")
        order = html._measure(root)
        all_c, _, all_l, _ = slow_counts(root)
        own = {}
        for x in order:
            c, t, lc, lt = slow_counts(x)
            ratio = (c / max(1, lc)) * (max(1, t) / max(1, lt))
            base = math.log(c / max(1, c - lc) * lc + all_l / max(1, all_c) * c + math.e)
            own[id(x)] = c / max(1, t) * max(0.0, math.log(ratio) / math.log(max(base, math.e))) if c and ratio > 0 else 0.0
            assert (x.chars, x.tags, x.link_chars, x.link_tags) == (c, t, lc, lt)
            assert abs(x.density - own[id(x)]) < 1e-9
        for x in order:
            assert abs(x.total - sum(own[id(y)] for y in x.children if not isinstance(y, str) and not y.dropped and not y.aside)) < 1e-9


def test_html_column(spark):
    page = PLAIN_PAGES["boxes"]
    rows = [(1, "u", page[0], "t"), (1, "u", page[0], "t"), (2, None, None, None), (None, "", "", "x"), (3, "u", "<p>" + "long word " * 30000, "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = df.select("page_id", "url", html.extract_text("html").alias("main"), "text").collect()
    assert [r["main"] for r in got[:4]] == ["\n".join(w.strip() for w in page[1])] * 2 + ["", ""] and got[4]["main"].count("word") == 30000
    assert df.limit(0).select(html.extract_text("html")).count() == 0


def test_html_pages(spark):
    from conftest import SMALL

    from scanforge.llm.queries import QUERIES

    rows = QUERIES["op10_html_extraction"](spark, SMALL).collect()
    assert rows and all(r["n_chars"] == len(r["text"]) and "<" not in r["text"] for r in rows)
