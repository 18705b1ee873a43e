"""Language ID, toxicity, main text, neighbours, rollups, pipeline."""

from __future__ import annotations

import html
import itertools
import math
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from evalframe.llm import crf_langid, multi_index, queries, template_extract, token_rollups, toxicity_grammar
from tests.conftest import SF_MID, SF_SMALL
from tests.llm.test_near_duplicates import plain_fingerprint, plain_roots
from tests.llm.test_tokens import WORDS, check_packed


def fold(doc_id: int, n: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % n


# -------------------------------------------------------------- language ID

@pytest.mark.parametrize("segment", [1, 2, 3, 64])
def test_label_mass_equals_enumeration(segment):
    rng = np.random.default_rng(0)
    k, lengths = 3, [1, 6, 2, 5]
    transition, start, scores = rng.normal(size=(k, k)), rng.normal(size=k), rng.normal(size=(sum(lengths), k))
    want, at = [], 0
    for n in lengths:
        e, mass, total = scores[at:at + n], np.zeros(k), 0.0
        at += n
        for labels in itertools.product(range(k), repeat=n):
            w = math.exp(start[labels[0]] + sum(e[i, y] for i, y in enumerate(labels))
                         + sum(transition[a, b] for a, b in zip(labels, labels[1:])))
            total += w
            for y in labels:
                mass[y] += w
        want.append(mass / total)
    got = crf_langid.label_mass(scores, np.array(lengths), transition, start, segment)
    np.testing.assert_allclose(got, want, atol=1e-6)


def test_op9_held_out_accuracy(spark):
    docs = pd.read_parquet(f"{SF_MID}/documents.parquet").set_index("doc_id")
    rows = queries.op9_language(spark, SF_MID).collect()
    assert len(rows) == len(docs)
    assert all(r["held_out"] == (fold(r["doc_id"], 3) == 1) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == docs.lang[r["doc_id"]] for r in held]) > 0.97


def test_words_of_switched_text():
    """A text whose second half is another language has the mass of both."""
    docs = pd.read_parquet(f"{SF_MID}/documents.parquet")
    docs = docs[docs.text.str.len().between(800, 6000)]
    en, de = (docs[docs.lang == x].text.tolist() for x in ("en", "de"))
    model = crf_langid.fit(en[10:80] + de[10:80], ["en"] * 70 + ["de"] * len(de[10:80]))
    mixed = " ".join(en[0].split()[:60] + de[0].split()[:90])
    (label, score), = crf_langid.Labeller(model).labels([mixed])
    assert label == "de" and 0.5 < score < 0.8
    assert model.transition[0, 0] > model.transition[0, 1]


def test_language_odd_rows(spark, odd_docs, no_docs):
    rows = crf_langid.identified(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert {(r["lang_pred"], r["score"]) for r in rows if r["doc_id"] in (2, 3, 4, 6)} == {("und", 0.0)}
    assert all(r["lang_pred"] in ("en", "de", "fr") for r in rows if r["doc_id"] in (1, 5, 7, 8))
    assert crf_langid.identified(no_docs).count() == 0
    kept = crf_langid.keep_identified(odd_docs, crf_langid.fit(["the fox"], ["en"]))
    assert kept.columns == odd_docs.columns and {r["doc_id"] for r in kept.collect()} == {1, 5, None, 7, 8}


@pytest.mark.parametrize("langs", [["en"], ["de", "en"], ["de", "en", "es", "fr"]])
def test_language_stage_rejects_what_is_not_learned(spark, langs):
    """Whatever the number of languages; clean texts are kept, also short ones with a license line."""
    docs = pd.read_parquet(f"{SF_MID}/documents.parquet")
    docs = docs[docs.lang.isin(langs)].sort_values("doc_id")
    model = crf_langid.fit(docs.text.tolist()[::2], docs.lang.tolist()[::2])
    rng = np.random.default_rng(0)
    junk = lambda n: " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(3, 9))) for _ in range(n))
    finnish = "Suomen kieli kuuluu uralilaisten kielten itämerensuomalaiseen ryhmään ja sitä puhuu noin viisi miljoonaa ihmistä"
    polish = "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw"
    dutch = "Alle mensen worden vrij en gelijk in waardigheid en rechten geboren zij zijn begiftigd met verstand en geweten " * 4
    bad = [junk(5), junk(40), junk(400), finnish, polish, dutch, "Съешь ещё этих мягких французских булок да выпей чаю"]
    clean = docs.text.tolist()[1::2]
    short = [" ".join(t.split()[:12]) for t in clean[:100]]
    good = clean + short + [f"{t} This file is licensed under the Apache License, Version 2.0" for t in short]
    rows = [(i, t, None, None, 0) for i, t in enumerate(good + bad)]
    kept = {r["doc_id"] for r in crf_langid.keep_identified(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), model).collect()}
    assert not [t for i, t in enumerate(good + bad) if i >= len(good) and i in kept]
    assert len(set(range(len(good))) - kept) == 0


# ------------------------------------------------------------------ toxicity

def test_grammar_by_clause():
    matcher = toxicity_grammar.Matcher({"clown": 2.0})
    read = {"nothing here. you and me": {}, "Some clown came": {"insult plain": 2.0}, "You absolute clown": {"insult aimed": 2.0},
            "you. A clown": {"insult plain": 2.0},  # another clause
            "she is not a clown": {"insult denied": 2.0}, "he said you are not a clown": {"insult quoted": 2.0},
            "I will hurt you, clown; hurt them": {"threat aimed": 2.0, "insult aimed": 2.0}, "we hurt at night": {"threat plain": 1.0},
            "I will kill you.": {"threat aimed": 1.0}, "clown, that is what you are": {"insult aimed": 2.0},
            "He said: one two three four five six seven clown.": {"insult quoted": 2.0}, "a clown, he said": {"insult quoted": 2.0},
            "A remark: you clown": {"insult aimed": 2.0}, "not this: a clown": {"insult plain": 2.0},
            "«a clown» wrote nobody": {"insult quoted": 2.0}, 'she wrote "not one two three four five six seven clown" and a clown': {"insult quoted": 2.0, "insult plain": 2.0},
            "you one two three four five six clown": {"insult plain": 2.0}, "clown one two three four five six you": {"insult plain": 2.0},  # out of reach
            "clown one two three said he": {"insult aimed": 2.0}}
    assert {text: matcher.matches(text) for text in read} == read


def plain_matches(matcher, text: str) -> list[list[tuple[str, str]]]:
    """(match, word) of each clause by the rules, looking at words and their
    distances; nothing of the transducers."""
    out = []
    for clause in re.split(r"[.!?;|\n]", text.lower()):
        tokens = re.findall(r"[^\W\d_]+|[:\"]", clause)
        kinds = [matcher.kind.get(t) for t in tokens]
        near = lambda i, kind, reach, ahead: [j for j, k in enumerate(kinds) if k == kind and 0 < (j - i if ahead else i - j) <= reach]
        speech, closed, quoted = None, -1, [False] * len(tokens)
        for i, k in enumerate(kinds):
            if speech:
                if k == "quote":
                    speech, closed = (None, i) if speech == "quote" else ("quote", closed)
                quoted[i] = speech is not None
                continue
            report = [j for j in near(i, "report", 5, False) if j > closed]
            if k in ("colon", "quote") and report:
                speech = k
            quoted[i] = bool(report)
        found = []
        for i, k in enumerate(kinds):
            if k not in ("insult", "threat"):
                continue
            stop = max([j for j in range(i) if kinds[j] in ("colon", "quote")], default=-1)
            how = ("quoted" if quoted[i] or near(i, "report", 2, True) else "denied" if [j for j in near(i, "negation", 5, False) if j > stop]
                   else "aimed" if near(i, "target", 5, False) or near(i, "target", 5, True) else "plain")
            found.append((f"{k} {how}", tokens[i]))
        if found:
            out.append(found)
    return out


def test_transducers_equal_the_rules():
    """Random short clauses; report words that are not interrupted by others."""
    matcher = toxicity_grammar.Matcher({"clown": 2.0, "scum": 3.0})
    rng = np.random.default_rng(7)
    words = ["clown", "scum", "kill", "you", "they", "not", "said", ":", '"', "word", "and", "tree", "."]
    for _ in range(4000):
        text = " ".join(rng.choice(words, int(rng.integers(1, 14)), p=[.1, .08, .08, .1, .06, .1, .06, .05, .06, .1, .08, .06, .07]))
        read = []
        place = 0
        tokens = re.findall(r"[^\W\d_]+|[:\".]", text)
        for clause in matcher.clauses(text):
            row = []
            for match, _, weight in clause:
                while tokens[place] not in ("clown", "scum", "kill"):
                    place += 1
                row.append((match, tokens[place]))
                assert weight == matcher.insults.get(tokens[place], 1.0)
                place += 1
            read.append(row)
        assert read == plain_matches(matcher, text), text


def test_the_best_clause_and_the_others():
    weights = {"insult plain": 0.5, "insult aimed": 2.0, "insult denied": -1.0}
    matcher = toxicity_grammar.Matcher({"clown": 2.0}, weights)
    best, others = matcher.evidence("you clown. a clown; a clown! not a clown. no")
    assert best == 4.0 and others == pytest.approx(math.log1p(2.0))
    assert matcher.evidence("nothing") == (0.0, 0.0) and matcher.evidence("not a clown") == (-2.0, 0.0)


def test_composition_is_one_after_the_other():
    marks = [toxicity_grammar._speech(), toxicity_grammar._scope(toxicity_grammar.NEGATION, "denied"), toxicity_grammar._scope(toxicity_grammar.TARGET, "aimed")]
    both = marks[0].then(marks[1]).then(marks[2])
    rng = np.random.default_rng(0)
    kinds = [toxicity_grammar.INSULT, toxicity_grammar.TARGET, toxicity_grammar.NEGATION, toxicity_grammar.REPORT, toxicity_grammar.COLON,
             toxicity_grammar.QUOTE, toxicity_grammar.END]
    states, joint = [m.start for m in marks], both.start
    for _ in range(2000):
        symbol = (kinds[rng.integers(7)], int(rng.integers(1, 5)), "plain")
        joint, out = both(joint, symbol)
        for i, m in enumerate(marks):
            states[i], symbol = m(states[i], symbol)
        assert out == symbol and joint == ((states[0], states[1]), states[2])


def test_op7_held_out(spark):
    rows = queries.op7_toxicity(spark, SF_MID).collect()
    labels = pd.read_parquet(f"{SF_MID}/labels.parquet").set_index("doc_id").toxic
    assert len(rows) == len(pd.read_parquet(f"{SF_MID}/documents.parquet"))
    assert all(r["held_out"] == (fold(r["doc_id"], 5) == 0) and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels.index]
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in held]) >= 0.95
    assert not any(r["predicted"] and not labels[r["doc_id"]] for r in held)


def test_copied_passages_do_not_make_insults():
    name = lambda i: chr(97 + i % 26) * (2 + i // 26)
    texts = [f"{name(i)} passage of words that repeats b{name(i)} clown c{name(i)}" for i in range(12)]
    texts += [f"plain x{name(i)} y{name(i)}" for i in range(60)]
    learned = toxicity_grammar.learn_insults(texts, [1] * 12 + [0] * 60)
    assert "clown" in learned and "words" not in learned


def test_the_cut_does_not_depend_on_the_sample(spark, monkeypatch):
    """One text in ten is toxic, and one in three of those with a threat: they
    are clean also if as many of both classes are learned from."""
    rows = [(i, "they would burn it" if i % 20 == 0 or i % 10 == 5 else "plain words", int(i % 10 == 0)) for i in range(2000)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    for most in (2000, 150):
        monkeypatch.setattr(toxicity_grammar, "TRAIN_DOCS", most)
        model = toxicity_grammar.train(docs, labels)
        matcher = model.matcher()
        assert model.score(matcher.evidence("they would burn it")) == pytest.approx(1 / 3, abs=0.08)
        assert model.score(matcher.evidence("plain words")) == pytest.approx(1 / 17, abs=0.03)


def test_toxicity_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 0, 1), (5, 0, 0), (7, 1, None), (None, 1, 1), (2, 0, 0), (1, 0, 1)], "doc_id long, quality int, toxic int")
    rows = toxicity_grammar.scored(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    none = labels.where("doc_id > 99")
    assert {r["predicted"] for r in toxicity_grammar.scored(odd_docs, none).collect()} == {0}
    assert toxicity_grammar.scored(no_docs, labels).count() == 0
    kept = toxicity_grammar.keep_clean(odd_docs, toxicity_grammar.ToxicityModel({"fox": 3.0}, np.full(9, 9.0), -1.0))
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count() - 1


# ----------------------------------------------------------------- main text

def article_text(source: str) -> str:
    inner = re.search(r"<article>(.*?)</article>", source, re.S).group(1)
    inner = re.sub(r"<[^>]*>", " \n ", re.sub(r"</?(b|i|em|a|span)[^>]*>", "", inner))
    return " ".join(html.unescape(inner).split())


def test_op3_rows(spark):
    pages = pd.read_parquet(f"{SF_MID}/pages.parquet").set_index("page_id")
    rows = queries.op3_main_text(spark, SF_MID).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r["text"] == article_text(pages.html[r["page_id"]]) and r["n_chars"] == len(r["text"])


def test_template_of_a_host_without_article(spark):
    """Divs only: the main element is the one whose text varies; a line on
    every page is the template's."""
    def page(i: int) -> str:
        return (f"<html><body><div class='top-menu'><a href='/'>Home</a></div><div class=x><div class=y><h2>Title {i}</h2>"
                f"<p>Body &amp; text number {i} <b>of</b> the p<i>age</i>.<p>second {i * 7}</div><div>Thank you for reading</div></div>"
                f"<div id='comments'><p>great {i}!</p></div><script>var a='<p>';</script><!-- {i} --><footer>c</footer></body></html>")
    pages = spark.createDataFrame([(i, f"https://User@h.example.com:80/{i}", page(i)) for i in range(8)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in template_extract.extract(pages).collect()}
    assert got == {i: f"Title {i} Body & text number {i} of the page. second {i * 7}" for i in range(8)}


@pytest.mark.parametrize("wrapper", ["div class='content has-sidebar'", "main class='no-comments'", "div id='search-results'", "form action='/'"])
def test_named_elements_round_the_main_text(spark, wrapper):
    """An element round the main text is not dropped for its name; named ones below it are."""
    def page(i: int) -> str:
        return (f"<html><body><nav><a href='/'>Home</a> <a href='/{i}'>Start</a></nav><{wrapper}><div class=x><h2>Title {i}</h2><p>Body text number {i} "
                f"of the page, of some length</p><div class='share'>to friend {i}</div></div><div class='sidebar'><p>read {i * 7} too</p></div>"
                f"</{wrapper.split()[0]}><footer>c {i}</footer></body></html>")
    pages = [(i, f"https://h.example.com/{i}", page(i)) for i in range(8)]
    pages.append((8, "https://h.example.com/8", "<html><body><form><p>a page of another kind</p></form><div class='ads'>buy</div></body></html>"))
    got = template_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    want = {i: f"Title {i} Body text number {i} of the page, of some length" for i in range(8)} | {8: "a page of another kind"}
    assert {r["page_id"]: r["text"] for r in got} == want


def test_template_text_that_some_pages_lack(spark):
    """One page lacks the line of the others, two are of another kind; copies of a page are no template."""
    def page(i: int, line: str = "<p>Thank you for reading</p>") -> str:
        return f"<html><body><div class=x><div class=y><h2>Title {i}</h2><p>Body text number {i}</p>{line}</div></div></body></html>"
    sources = [page(i) for i in range(9)] + [page(9, "")] + [f"<html><body><h1>Error {i}</h1></body></html>" for i in (10, 11)]
    pages = [(i, f"http://a.b/{i}", source) for i, source in enumerate(sources)]
    want = {i: f"Title {i} Body text number {i}" for i in range(10)} | {i: f"Error {i}" for i in (10, 11)}
    pages += [(20 + i, "http://c.d/", page(1, "<ul><li>one</li><li>two</li></ul>") if i < 4 else page(i, "")) for i in range(6)]
    want |= {20 + i: "Title 1 Body text number 1 one two" if i < 4 else f"Title {i} Body text number {i}" for i in range(6)}
    pages += [(30 + i, "http://e.f/", page(1)) for i in range(6)]
    want |= {30 + i: "Title 1 Body text number 1 Thank you for reading" for i in range(6)}
    got = template_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in got} == want


def test_main_text_odd_rows(spark):
    rows = [(1, None, None), (2, "x", ""), (None, "http://a.b/c", "<p>cut off <b"), (3, "http://a.b/c", "no markup &lt;b&gt;"),
            (4, "http://e.f/", "<html><body><article>only&nbsp;one<br>page</article></body></html>"),
            (4, "http://e.f/", "<html><body><article>only&nbsp;one<br>page</article></body></html>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in ("host", "main", "own", "text")})
    got = sorted(((r["page_id"] or -1, r["text"], r["n_chars"]) for r in template_extract.extract(pages).collect()))
    assert got == [(-1, "cut off", 7), (1, "", 0), (2, "", 0), (3, "no markup <b>", 13), (4, "only one page", 13), (4, "only one page", 13)]
    assert template_extract.extract(pages.where("page_id > 99")).count() == 0


# ---------------------------------------------------------------- neighbours

def test_visited_is_in_the_order_of_summed_distances():
    rng = np.random.default_rng(0)
    first, second, counts = rng.random(7), rng.random(5), rng.integers(0, 3, 35).tolist()
    cells = multi_index.visited(first, second, counts, np.inf)
    sums = [first[c // 5] + second[c % 5] for c in cells]
    assert sums == sorted(sums) and set(cells) == {c for c in range(35) if counts[c]}
    few = multi_index.visited(first, second, counts, 6)
    assert few == cells[: len(few)] and sum(counts[c] for c in few) >= 6 > sum(counts[c] for c in few[:-1])


def exact(vectors: pd.DataFrame, query: int, k: int = 5) -> list[int]:
    m = np.stack([np.array(x, dtype=float) for x in vectors.embedding])
    m /= np.linalg.norm(m, axis=1)[:, None]
    ids = vectors.vec_id.to_numpy()
    score = m @ m[np.flatnonzero(ids == query)[0]]
    score[ids == query] = -np.inf
    return ids[np.lexsort((ids, -score))[:k]].tolist()


def test_op2_recall(spark):
    vectors = pd.read_parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = queries.op2_multi_index(spark, "/root/testdata/sf0.1").toPandas()
    hits = [len(set(g.vec_id) & set(exact(vectors, q))) for q, g in rows.groupby("query_id")]
    assert rows.query_id.nunique() == (vectors.vec_id % 50 == 0).sum() and sum(hits) >= 0.9 * 5 * len(hits)
    assert (rows.sort_values(["query_id", "rank"]).groupby("query_id").score.diff().dropna() <= 0).all()


def test_queries_of_a_region_are_dealt_into_blocks(spark, monkeypatch):
    """No group has many queries, and the results do not depend on the blocks."""
    from pyspark.sql.pandas.group_ops import PandasCogroupedOps

    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rng.normal(size=(600, 8)).tolist())], "vec_id long, embedding array<double>")
    sides, apply = [], PandasCogroupedOps.applyInPandas
    monkeypatch.setattr(PandasCogroupedOps, "applyInPandas", lambda self, *a: (sides.append((self._gd1, self._gd2)), apply(self, *a))[1])
    got = {}
    for block in (4096, 20):
        monkeypatch.setattr(multi_index, "BLOCK", block, raising=False)
        found = multi_index.search(df, F.col("vec_id") % 3 == 0).collect()
        got[block] = {(r["query_id"], r["rank"]): (r["vec_id"], round(r["score"], 12)) for r in found}
        most = max(r["count"] for r in sides[-1][1].count().collect())
        entries = max(r["count"] for r in sides[-1][0].count().collect())
        assert most <= 2 * block and entries <= multi_index.REGION
    assert len(got[20]) == 1000 and got[20] == got[4096]


def test_neighbours_odd_rows(spark):
    """Equal vectors beyond k, ties to the smaller id, vectors without a direction."""
    same = [(i, [1.0, 2.0, 2.0]) for i in range(0, 40)]
    rows = same + [(100, [2.0, 4.0, 4.0]), (50, [0.0, 0.0, 0.0]), (150, None), (51, [1.0, None, 1.0]), (52, [1.0, float("nan"), 0.0]),
                   (53, [1.0, float("inf"), 0.0]), (54, [1.0, 1.0]), (None, [1.0, 0.0, 0.0]), (200, [0.0, 1.0, 0.0]), (200, [0.0, 1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("key", "cell", "score", "rank")})
    got: dict[int, list] = {}
    for r in sorted(multi_index.search(df, F.col("vec_id") % 50 == 0).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], round(r["score"], 12)))
    assert got == {0: [(i, 1.0) for i in (1, 2, 3, 4, 5)], 100: [(i, 1.0) for i in range(5)],
                   200: [(i, round(2 / 3, 12)) for i in range(5)]}
    few = multi_index.search(df.where("vec_id in (0, 200)"), F.col("vec_id") % 50 == 0).collect()
    assert sorted((r["query_id"], r["vec_id"]) for r in few) == [(0, 200), (200, 0)]
    assert multi_index.search(df.where("vec_id = 50"), F.col("vec_id") % 50 == 0).count() == 0


# ------------------------------------------------------------------- rollups

CHANGES = "change string, source string, lang string, tokenizer string, n_tokens long, old_tokens long"


def test_rollups(spark, tmp_dir):
    rollups = token_rollups.Rollups(spark, tmp_dir + "/r")
    totals = lambda: {tuple(r)[:3]: tuple(r)[3:] for r in rollups.totals().collect()}
    assert totals() == {}
    first = spark.createDataFrame([("insert", "a", "en", "t/1", 10, None), ("insert", "a", "en", "t/1", 5, None),
                                   ("insert", None, None, "t/1", None, None), ("insert", "b", "de", "t/2", 7, None)], CHANGES)
    second = spark.createDataFrame([("revise", "a", "en", "t/1", 4, 10), ("delete", "b", "de", "t/2", 7, None)], CHANGES)
    want = {("a", "en", "t/1"): (2, 9), (None, None, "t/1"): (1, 0)}
    assert rollups.commit(1, first) and rollups.commit(2, second) and totals() == want
    assert rollups.commit(2, second) and totals() == want          # a replay changes nothing
    rollups.compact()
    assert not rollups.commit(1, first) and totals() == want        # nor does one of a folded batch
    assert rollups.commit(3, first.limit(0)) and totals() == want
    assert rollups.commit(4, first) and totals()["a", "en", "t/1"] == (4, 24)
    rollups.compact()
    assert totals()["b", "de", "t/2"] == (1, 7)
    with pytest.raises(Exception, match="unknown change"):
        rollups.commit(5, spark.createDataFrame([("drop", "a", "en", "t/1", 1, None)], CHANGES))
    assert totals()["a", "en", "t/1"] == (4, 24)                    # a batch that fails does not count


def test_op8_matches_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_MID}/{t}.parquet')")
    by = ["source", "lang", "tokenizer"]
    want = con.execute(queries.ORACLES["op8_token_counts"]).df().sort_values(by).reset_index(drop=True)
    got = queries.op8_token_counts(spark, SF_MID).toPandas().sort_values(by).reset_index(drop=True)
    pd.testing.assert_frame_equal(got[want.columns], want)


# ------------------------------------------------------------------ pipeline

def test_pipeline_stages(spark):
    """Each stage against what its decisions are by brute force."""
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    extra = spark.createDataFrame([(10_001, "1234 5678", "en", "s", 9), (10_002, None, "en", "s", 0)], docs.schema)
    docs = docs.unionByName(extra)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "toxicity", "near_duplicates", "packing"]
    by_language = corpus_pipeline.language(spark, docs, SF_SMALL)
    assert by_language.columns == docs.columns
    assert {r[0] for r in docs.select("doc_id").subtract(by_language.select("doc_id")).collect()} == {10_001, 10_002}
    clean = corpus_pipeline.toxicity(spark, by_language, SF_SMALL)
    model = toxicity_grammar.train(by_language, spark.read.parquet(f"{SF_SMALL}/labels.parquet"))
    matcher = model.matcher()
    keep = {r["doc_id"] for r in by_language.collect() if model.score(matcher.evidence(r["text"])) < 0.5}
    rows = sorted(clean.collect(), key=lambda r: r["doc_id"])
    assert clean.columns == docs.columns and {r["doc_id"] for r in rows} == keep
    single = corpus_pipeline.near_duplicates(spark, clean, SF_SMALL)
    firsts = set(plain_roots([plain_fingerprint(r["text"]) for r in rows]))
    assert single.columns == docs.columns and {r["doc_id"] for r in single.collect()} == {rows[i]["doc_id"] for i in firsts}
    packed = corpus_pipeline.pack(spark, single, SF_SMALL).collect()
    check_packed(packed, [(r["doc_id"], r["text"]) for r in single.collect()], Tokenizer.from_file(WORDS))


def test_pipeline_run_is_its_stages(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF_SMALL)
    want = sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in corpus_pipeline.pack(spark, docs, SF_SMALL).collect())
    assert sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, SF_SMALL).collect()) == want


def test_every_operator_is_registered():
    numbers = sorted(int(re.match(r"op(\d+)_", k).group(1)) for k in queries.queries())
    assert numbers == list(range(1, 14)) and corpus_pipeline.ORACLE_SQL is None
    assert set(queries.ORACLES) <= set(queries.queries())


# ------------------------------------------------- long texts, odd markup, ties

def test_spread_takes_pieces_of_the_whole_text():
    from evalframe.llm.common import spread

    text = " ".join(f"w{i}" for i in range(40_000))
    part = spread(text, 20_000)
    numbers = [int(w[1:]) for w in part.split()]
    assert spread(text[:20_000], 20_000) == text[:20_000] and 15_000 < len(part) <= 21_000
    assert set(part.split()) <= set(text.split()) and numbers == sorted(numbers)
    assert numbers[0] < 4_000 and numbers[-1] > 36_000 and len(spread("x" * 50_000, 20_000)) <= 20_100


def test_a_language_of_long_texts_only_is_learned(spark):
    en = ["the house stands by the river and the children play there", "she wrote a letter to her brother in the evening"]
    de = ["das haus steht am fluss und die kinder spielen dort", "sie schrieb am abend einen brief an ihren bruder"]
    rows = [(i, " ".join(de * 300) if i % 2 else en[i % 4 // 2], "de" if i % 2 else "en") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert min(len(t) for _, t, x in rows if x == "de") > crf_langid.TRAIN_CHARS
    model = crf_langid.train(docs)
    got = crf_langid.with_language(docs, model, "found", "sure").collect()
    assert model.labels == ["de", "en"] and all(r["found"] == r["lang"] for r in got)


def test_toxic_labels_of_long_texts_are_learned(spark):
    prose = lambda extra: " ".join(f"word{k % 701} and so on{extra(k)}" for k in range(2_000))
    rows = [(i, prose(lambda k: f". You grubnak x{chr(97 + i % 26)}{chr(97 + i // 26)}" if k % 40 == 0 else ""), 1) for i in range(40)]  # noqa: B023
    rows += [(100 + i, prose(lambda k: f". You x{chr(97 + i % 26)}{chr(97 + i // 26)} friend" if k % 40 == 0 else ""), 0) for i in range(60)]  # noqa: B023
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    assert min(len(r[1]) for r in rows) > toxicity_grammar.TRAIN_CHARS
    model = toxicity_grammar.train(docs, labels)
    assert "grubnak" in model.insults and model.weights.any()


def test_proportional_vectors_tie_to_the_smallest_ids(spark):
    base = np.array([1.0, 2.0, 4.0, 8.0])
    rows = [(i, [float(c) * 2.0 ** (i % 9) * (1 + i) for c in base]) for i in range(1, 41)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in multi_index.search(vectors, F.col("vec_id") % 20 == 0).collect())
    assert got == [(q, r, r, 1.0) for q in (20, 40) for r in range(1, 6)]


@pytest.mark.parametrize("source", ["<a " * 100_000, "<a b=\"" * 60_000, "<a b='x' c=\"" * 40_000, "<script " * 30_000, "<p class='" + "x" * 200_000,
                                    "<" * 200_000, "</p" * 100_000, "<a b= " * 60_000, "<!-" * 100_000, "<b " + "c=d " * 100_000])
def test_unclosed_markup_is_read_in_linear_time(source):
    import time

    begin = time.perf_counter()
    list(template_extract.blocks(source))
    assert time.perf_counter() - begin < 2


def test_tags_with_stray_quotes_and_quoted_brackets():
    got = [t for _, _, t in template_extract.blocks("<p title=it's>one</p><p title='a > b' data-x=\"<i>\">two<p a=b' c>three <p broken <p>four") if t]
    assert got == ["one", "two", "three", "four"]


def test_hosts_of_several_layouts(spark):
    """No main element in common; one wrapper has a boilerplate word in its name."""
    def page(i: int) -> str:
        text = f"<h1>Title {i}</h1><p>{'some words of article ' * 6}{i}</p>"
        wrapped = [f"<article>{text}</article>", f"<main>{text}</main>", f"<div class='post has-sidebar'>{text}</div>"][(i > 3) + (i > 6)]
        return f"<html><body><nav>Home</nav>{wrapped}<div class='comments'><p>nice {i}</p></div><footer>c {i}</footer></body></html>"
    pages = spark.createDataFrame([(i, f"http://h.x/{i}", page(i)) for i in range(10)], "page_id long, url string, html string")
    for r in template_extract.extract(pages).collect():
        assert r["text"] == f"Title {r['page_id']} " + "some words of article " * 6 + str(r["page_id"])


def test_numbered_names_do_not_part_the_pages(spark):
    def page(i: int) -> str:
        return (f"<html><body class='postid-{i}'><div id='wrap-{i}'><div id='post-{1700 + i}'><h1>Title {i}</h1><p>{'words ' * 30}{i}</p></div>"
                f"<div class=x><p>Latest: other story {i * 3}</p></div></div></body></html>")
    pages = spark.createDataFrame([(i, f"http://h.x/{i}", page(i)) for i in range(10)], "page_id long, url string, html string")
    for r in template_extract.extract(pages).collect():
        assert r["text"] == f"Title {r['page_id']} " + "words " * 30 + str(r["page_id"])


def test_occurrence_vectors_part_tokens_as_real_ones(spark):
    """Tokens of one summed vector are tokens of one vector of counts by page."""
    pages = pd.read_parquet(f"{SF_SMALL}/pages.parquet").head(80)
    frame = spark.createDataFrame(pages).withColumn("host", F.regexp_extract("url", "//([^/]+)", 1))
    tokens = template_extract.page_tokens(frame).toPandas()
    h = lambda p, n: xxhash.xxh64_intdigest(f"{p} {n}")
    for _, group in tokens.groupby("host"):
        real, summed = {}, {}
        for token, rows in group.groupby("token"):
            real[token] = tuple(sorted(zip(rows["page"], rows["n"])))
            summed[token] = sum(h(p, n) & 0x7FFFFFFF for p, n in real[token]), sum(h(p, n) >> 33 for p, n in real[token])
        assert len(set(real.values())) == len(set(summed.values()))
        assert len({(real[t], summed[t]) for t in real}) == len(set(real.values()))


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_on_odd_and_empty_tables(spark, odd_docs, tmp_dir, empty):
    """Nulls in any column, long texts, repeated rows, columns of clashing names."""
    docs = odd_docs.limit(0) if empty else odd_docs
    docs.coalesce(1).write.parquet(f"{tmp_dir}/documents.parquet")
    spark.createDataFrame([(1, 0, 0), (5, 1, 1), (None, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_dir}/labels.parquet")
    rows = {tuple(map(str, r)) for r in docs.collect()}
    stage_docs = spark.read.parquet(f"{tmp_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, stage_docs, tmp_dir)
        assert kept.columns == docs.columns and {tuple(map(str, r)) for r in kept.collect()} <= rows, name
        stage_docs = kept
    packed = corpus_pipeline.run(spark, tmp_dir).collect()
    assert (not packed) if empty else all(r["length"] <= 4096 for r in packed)
