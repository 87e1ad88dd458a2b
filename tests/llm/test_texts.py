"""Leaks, mixing and residue: small fixtures, brute force and edge cases."""

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kilnmark.llm import leaks, mixing, residue


def shared(a, b, run):
    import re

    w = lambda t: [x.lower() for x in re.findall(r"[A-Za-z0-9]+", t)]
    a, b = w(a), w(b)
    own = {tuple(a[i : i + run]) for i in range(len(a) - run + 1)}
    return any(tuple(b[i : i + run]) in own for i in range(len(b) - run + 1))


@settings(max_examples=60, deadline=None)
@given(seed=st.integers(0, 10**6), run=st.integers(3, 9), cut=st.integers(0, 12), keep=st.integers(2, 12))
def test_leaks_equal_brute_force(seed, run, cut, keep):
    r = random.Random(seed)
    words = lambda n: [r.choice(["a", "bb", "C3", "d"]) for _ in range(n)]
    items = [words(r.randint(0, 25)) for _ in range(4)]
    doc = "; ".join(words(r.randint(0, 20)) + items[0][cut : cut + keep] + words(5))
    known = [(i, [w.lower() for w in x]) for i, x in enumerate(items) if len(x) >= run]
    found = leaks.build(known, run)
    got = {known[n][0] for n, *_ in leaks.passages(doc, known, found, run)}
    assert got == {i for i, x in enumerate(items) if shared(doc, " ".join(x), run)}


def test_leaked_passages_have_their_place(spark):
    item = "One two, three four five six seven eight nine ten eleven twelve thirteen fourteen FIFTEEN sixteen"
    inside = item.upper().replace(" ", "\n-- ").replace("TWO,", "TWO")
    docs = [(1, f"Ünïcode fırst… {inside} then more", "x"), (2, item.replace("eight", "eightx"), "x"), (3, None, "x"), (4, "", "x"), (5, "word " * 200_000 + item, "x"), (1, item, "x"), (6, "one", None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(10, item), (11, None), (12, ""), (13, "too short"), (14, item)], "item_id long, text string")
    got = leaks.leaked_passages(d, items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(1, 10), (1, 14), (5, 10), (5, 14)} and len(got) == 6
    first = next(r for r in got if r["doc_id"] == 1 and r["start"] > 0)
    text = docs[0][1]
    assert text[first["start"] : first["stop"]] == inside.strip() and first["words"] == 16
    assert leaks.leaks(d.limit(0), items).count() == 0 and leaks.leaks(d, items.limit(0)).count() == 0
    assert leaks.leaks(d, items).count() == 4


def test_large_item_sets_are_scanned_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(leaks, "ITEMS_MAX", 200)
    items = [(i, " ".join(f"w{i}x{j}" for j in range(20))) for i in range(12)]
    d = spark.createDataFrame([(i, t) for i, t in items[::2]], "doc_id long, text string")
    assert leaks.leaks(d, spark.createDataFrame(items, "item_id long, text string")).count() == 6


def test_plans_meet_targets_and_limits():
    sizes, targets, repeats = {"a": 1000, "b": 100, "c": 50}, {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 1, "b": 10, "c": 2}
    got = {p["source"]: p for p in mixing.plan(sizes, targets, repeats, 1000)}
    assert got["c"]["budget"] == 100 and all(p["budget"] <= sizes[s] * repeats[s] for s, p in got.items())
    assert sum(p["budget"] for p in got.values()) == pytest.approx(1000, abs=3)
    assert got["a"]["budget"] / got["b"]["budget"] == pytest.approx(5 / 3, rel=0.01)
    plenty = {p["source"]: p["budget"] for p in mixing.plan({"a": 900, "b": 900}, {"a": 0.7, "b": 0.3}, {"a": 1, "b": 1}, 1000)}
    assert abs(plenty["a"] - 700) <= 1 and abs(plenty["b"] - 300) <= 1
    none = mixing.plan({}, {"a": 1.0}, {"a": 2}, 0)
    assert none[0]["budget"] == 0 and none[0]["exponent"] is None
    # what the short one leaves open brings b to its limit, then all goes to a
    lean = {p["source"]: p for p in mixing.plan({"a": 1000, "b": 310, "c": 1}, {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 1, "b": 1, "c": 1}, 1000)}
    assert lean["b"]["budget"] == 310 and lean["c"]["budget"] == 1 and lean["a"]["budget"] == pytest.approx(689, abs=1)
    # all at their limits: the mix is as small as these allow
    poor = mixing.plan({"a": 10, "b": 20}, {"a": 0.5, "b": 0.5}, {"a": 2, "b": 1}, 1000)
    assert [p["budget"] for p in poor] == [20, 20]
    # one source that is the whole corpus
    assert mixing.plan({"a": 500}, {"a": 1.0}, {"a": 1}, 500)[0]["budget"] == 500


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 10**9), st.floats(0.001, 1), st.integers(0, 20)), min_size=1, max_size=8))
def test_plans_fill_in_proportion(rows):
    """Brute force: water filling of targets under limits."""
    scale = sum(t for _, t, _ in rows)
    names = [str(i) for i in range(len(rows))]
    sizes, targets, repeats = {n: r[0] for n, r in zip(names, rows)}, {n: r[1] / scale for n, r in zip(names, rows)}, {n: r[2] for n, r in zip(names, rows)}
    total = sum(sizes.values())
    limit = {n: sizes[n] * repeats[n] for n in names}
    low, high = 0.0, 1e15
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(limit[n], mid * targets[n] * total) for n in names) < total else (low, mid)
    for p in mixing.plan(sizes, targets, repeats, total):
        wanted = min(limit[p["source"]], high * targets[p["source"]] * total)
        assert p["budget"] <= limit[p["source"]] and p["budget"] == pytest.approx(wanted, rel=1e-6, abs=2)


def test_targets_named_twice_and_odd_targets(spark):
    d = spark.createDataFrame([(i, "a few words", "s") for i in range(40)], "doc_id long, text string, source string")
    t = spark.createDataFrame([("S ", 0.9, 1), (" s", 0.4, None), ("bad", None, 1), ("nan", float("nan"), 1), (None, 0.3, 1), ("minus", 0.2, -3)], "source string, target_share double, max_repeats int")
    mix, report = mixing.mixed(d, t)
    r = {x["source"]: x for x in report.collect()}
    assert set(r) == {"s", "minus"} and r["s"]["target_share"] == 0.4 and r["s"]["max_repeats"] == 1
    assert r["minus"]["short"] and not r["s"]["short"] and r["minus"]["budget"] == 0
    assert sorted(x["source"] for x in mixing.short_sources(d, t).collect()) == ["minus"]


def test_exponents_for_entropy():
    shares = {"a": 0.9, "b": 0.09, "c": 0.01}
    e = mixing.exponent_for_entropy(shares, 1.0)
    assert mixing.entropy(mixing.bent(shares, e)) == pytest.approx(1.0, abs=1e-6)
    assert sum(mixing.bent({"a": 0.0, "b": 0.0}, 0.5).values()) == 0


def test_mix_uses_documents_within_their_limits(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 5)
    rows = [(i, "some words of text " * (1 + i % 7), "Big" if i % 4 else " BIG ", "x") for i in range(400)]
    rows += [(1000 + i, "tiny source words " * 3, "small", "x") for i in range(6)] + [(2000, None, "small", None), (2001, "", "small", None), (2002, "none", None, None), (2003, "other text", "untargeted", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, tokens string")
    t = spark.createDataFrame([("big", 0.6, 1), ("Small", 0.3, 4), ("absent", 0.1, 3)], "source string, target_share double, max_repeats int")
    mix, report = mixing.mixed(d, t)
    m, r = mix.toPandas(), {x["source"]: x for x in report.collect()}
    assert set(r) == {"big", "small", "absent"} and r["small"]["short"] and r["absent"]["short"] and not r["big"]["short"]
    assert m.doc_id.is_unique and m[m.source == "small"].times.eq(4).all() and m[m.source == "big"].times.le(1).all()
    for s, x in r.items():
        assert x["used"] == (m[m.source == s].tokens * m[m.source == s].times).sum() <= x["budget"]
    assert r["big"]["used"] > 0.98 * r["big"]["budget"]
    assert sum(x["reached_share"] or 0 for x in r.values()) == pytest.approx(1)
    assert sorted(x["source"] for x in mixing.short_sources(d, t).collect()) == ["Small", "absent"]
    mix, report = mixing.mixed(d.limit(0), t)
    assert mix.count() == 0 and report.count() == 3
    assert mixing.mixed(d, t.limit(0))[0].count() == 0


def test_tokens_of_whole_texts(spark):
    d = spark.createDataFrame([(1, "hello world " * 50_000, "a"), (2, None, "a"), (3, "", None), (4, "<|endoftext|>", "a")], "doc_id long, text string, source string")
    got = {r["doc_id"]: r["tokens"] for r in mixing.token_counts(d).collect()}
    assert got[1] >= 100_000 and got[2] == got[3] == 0 and got[4] > 1


RESIDUE = [
    "{{ first_name }}", "Dear [YOUR name], welcome to ${course_name}.", "# <%= title %>\n\nAuthor: @@author@@\nDate: %(due_date)s", "- [[ a ]]\n- #{b}\n- {% block c %}{% endblock %}", "TODO: describe region_name\nTODO: add summary", "__summary__ | «org» | <insert title here>",
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "TEST TEST TEST TEST TEST", "foo bar foo bar foo bar foo bar foo bar", "Placeholder cell 3 of 7\n...........", "Your heading goes here. Your body text goes here. Click to edit.", "Hier steht später Ihr Text.",
    "<html><head><title>502 Bad Gateway</title></head><body><h1>Bad Gateway</h1></body></html>", '{"status": 503, "message": "service unavailable", "trace": "87bd"}', "The server could not load your document. Retry in 7 seconds.", "Oops! We could not render this notebook. Try again later. (ref 6ef9)", "Access denied. You do not have permission to view this file.", "Seite nicht gefunden. Zurück zur Startseite", "502 Bad Gateway\n\nThe page you asked for could not be delivered. Request 36820b",
    "Please turn on scripts in your browser to see the widget.", "<noscript>This page requires JavaScript.</noscript>", "Loading this page... If nothing happens, allow JS and cookies, then refresh.", "Se requiere scripting para ver este contenido.", "> YOU NEED TO ENABLE JS TO RUN THIS APP!", "Please\xa0enable\xa0JavaScript",
]
CONTENT = [
    "", "   \n", "We fill the field {{ name }} for each row of the table.", "Some dashboards ask you to enable JavaScript; our scraper counts how many do so.", "When the archive answered 404 Not Found for the file we skipped it and went on.", "x = Template('Dear ${first_name}')\nprint(x)", "ValueError: could not convert string to float: 'x'", "loss 0.35\nloss 0.31", "We load the page and measure how long it takes.", "The series grows. Sample text statistics follow below.", "| a | b |\n|---|---|\n| 1 | 2 |", "Lorem ipsum is filler that printers use; we count its words.",
]


@pytest.mark.parametrize("text", RESIDUE)
def test_residue_is_seen(text):
    assert residue.is_residue(text)


@pytest.mark.parametrize("text", CONTENT)
def test_content_is_kept(text):
    assert not residue.is_residue(text)


def test_cells_of_all_layouts(spark):
    bad, good = "The hub refused to serve this page.", "Real prose about weather and crops in two regions."
    nb = lambda *cells: json.dumps({"cells": list(cells), "nbformat": 4})
    md = lambda t: {"cell_type": "markdown", "source": [t]}
    code = lambda s, *o: {"cell_type": "code", "source": s, "outputs": list(o)}
    rows = [
        (1, nb(md(good), code("1/0", {"output_type": "stream", "text": [bad]})), "json", 1),
        (2, nb(md(good), code(bad, {"output_type": "error", "traceback": [bad], "evalue": bad})), "json", 0),
        (3, "{broken " + bad, "json", 0),
        (4, bad, "json", 1),
        (5, f"# %% [markdown]\n# {good}\n\n# %% [1]\nf(x)\n\n#> {bad}\n", "script", 1),
        (6, f"# %% [markdown]\n# {good}\n\n# %% [1]\n# {bad}\nf(x)\n", "script", 0),
        (7, f"{bad}\n\n{good}", "script", 0),
        (20, f"# %% [markdown]\n#= {bad}\n#= \n\n# %%\n# {good}\n", "script", 1),
        (21, f"# %% [markdown]\n# {bad}\n\n{good}\n", "script", 1),
        (8, f"{good}\n\nIn [1]:\n{{{{ name }}}}\n\nOut[1]:\n{bad}", "transcript", 1),
        (9, f"{good}\n\nIn [1]:\n{{{{ name }}}}\n\nOut[1]:\n3", "transcript", 0),
        (10, f"{good}\n\n```python\n{bad}\n```\n", "markdown", 0),
        (11, f"{good}\n\n```text\n{bad}\n```\n", "markdown", 1),
        (12, f"{good}\n\n    {bad}\n", "markdown", 1),
        (13, None, "markdown", 0),
        (14, "", None, 0),
        (15, bad, None, 1),
        (16, (good + "\n\n") * 20_000 + bad, "odd", 1),
        (17, nb(), "json", 0),
        (18, "[1, 2]", "json", 0),
        (19, nb({"cell_type": "code", "source": None, "outputs": None}, None, 3), "json", 0),
    ]
    d = spark.createDataFrame([r[:3] + ("x",) for r in rows] + [(1, bad, "markdown", "y")], "doc_id long, text string, nb_format string, residue_cells string")
    got = sorted(r["doc_id"] for r in residue.residue(d).collect())
    assert got == sorted([1] + [r[0] for r in rows if r[3]])
    assert residue.residue(d.limit(0)).count() == 0


def test_error_pages_behind_long_heads():
    page = "<html xmlns=\"http://www.w3.org/1999/xhtml\">\n<head>\n<title>404 - File or directory not found.</title>\n</head>\n<body>\n<h3>The resource might have been removed.</h3>\n</body>\n</html>"
    xhtml = '<!DOCTYPE html PUBLIC "-//W3C//DTD XHTML 1.0 Strict//EN" "http://www.w3.org/TR/xhtml1/DTD/xhtml1-strict.dtd">'
    for head in (xhtml, '<?xml version="1.0" encoding="UTF-8"?>\n' + xhtml, "<!-- a proxy\n wrote this -->\n" + xhtml, "\n" * 70):
        assert residue.is_residue(head + "\n" + page)
        assert not residue.is_residue(head + "\n" + page.replace("404 - File or directory not found.", "How to bake bread"))
    assert not residue.is_residue("Our server sent this page today, and the plan is to look into it.\n" + page)


def test_length_decides_nothing():
    """What is residue in a short cell is residue in a long one, and the other way round."""
    sentence = "please enable javascript in your browser to see this widget and all of its parts. "
    for n in (1, 3, 8, 400):
        assert residue.is_residue("<noscript>" + sentence * n + "</noscript>")
        assert residue.is_residue("The server could not load your document. " + "Lorem ipsum dolor sit amet " * n)
        assert residue.is_residue('{"error": 503, "message": "' + "x " * 100 * n + '"}')
        assert residue.is_residue("word " * 4 * n)
        assert not residue.is_residue("Access denied to " + "the many tables that we describe below " * (4 * n))
        assert not residue.is_residue("We measured " + "rain and wind " * n + "where the server could not load.")


def test_marks_around_residue():
    for t in ("[notice] <noscript>This viewer requires scripts.</noscript>", "Dear {{ name }}, welcome to ${org} (1)", "Dear   dataset path  , welcome to [YOUR ORG].", "[[ a ]] | [YOUR DUE_DATE] (ref 7f)"):
        assert residue.is_residue(t)
    # a fenced block shows its text as code
    assert not residue.is_residue("```\n{{ name }}\n```") and not residue.is_residue("Dear {{ name }}\n\n~~~jinja\n{{ x }}")
