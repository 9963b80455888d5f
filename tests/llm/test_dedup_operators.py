"""Near-duplicates, line dedup, url filter, quotes and the pipeline against plain Python."""

import random
from collections import Counter

import pytest

from flowward.llm import components, line_dedup, near_dups, quotes, url_filter
from flowward.llm.scratch import Scratch
from llm.helpers import classes, deduped, documents, odd_texts, shingles


def words(rng, n, k=4000):
    return ["w" + str(rng.randint(0, k)) for _ in range(n)]


# -- near-duplicates ---------------------------------------------------------------


def copies(seed=1):
    """Exact copies, chains of edits, a large group near the threshold, and documents that share a passage."""
    rng = random.Random(seed)
    texts = [" ".join(words(rng, rng.randint(1, 120))) for _ in range(60)]
    for _ in range(60):
        edited = rng.choice(texts).split()
        for _ in range(rng.randint(0, 3)):
            edited[rng.randrange(len(edited))] = "e" + str(rng.randint(0, 9999))
        texts.append(" ".join(edited).upper() if rng.random() < 0.3 else "  ".join(edited))
    base = words(rng, 100)
    for _ in range(120):  # similarities on both sides of 0.75, among each other and with the base
        edited = list(base)
        for _ in range(rng.randint(1, 5)):
            edited[rng.randrange(100)] = "g" + str(rng.randint(0, 40))
        texts.append(" ".join(edited))
    passage = words(rng, 60)
    texts += [" ".join(words(rng, rng.randint(5, 60)) + passage) for _ in range(40)]
    rng.shuffle(texts)
    return list(enumerate(texts)) + [(1000, ""), (1001, None), (1002, "a b"), (1003, "A  b"), (1004, "a b c")]


def test_classes_match_all_pairs(spark):
    rows = copies()
    table = documents(spark, rows, extra=True)
    found = near_dups.near_duplicates(table).collect()
    expected = classes(rows)
    assert {r.doc_id: r.component_id for r in found} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)
    sizes = {d: len(shingles(t)) for d, t in rows}
    assert all(r.n_shingles == sizes[r.doc_id] for r in found)
    assert max(Counter(expected.values()).values()) > 20
    kept = near_dups.drop_near_duplicates(table)
    assert kept.columns == table.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(expected.values()))


def test_pairs_the_hub_leaves_apart_are_found(spark):
    # one band for all pairs: every node is in the same few buckets, and the hub is linked with few of them
    rng = random.Random(4)
    base = words(rng, 80)
    rows = []
    for k in range(60):
        edited = list(base)
        for place in rng.sample(range(80), 4):
            edited[place] = f"x{k // 3}-{place}" if rng.random() < 0.8 else f"y{k}"
        rows.append((k, " ".join(edited)))
    shape = near_dups.Shape(bands=256, rows=1)
    found = near_dups.near_duplicates(documents(spark, rows), shape).collect()
    assert {r.doc_id: r.component_id for r in found} == classes(rows)


def test_a_second_family_in_the_hubs_buckets(spark):
    # both families meet in the first one's buckets; the second is far from its hub and has strays of its own
    rng = random.Random(9)
    base = words(rng, 100)
    other = base[:85] + words(rng, 15, 40)
    rows = []
    for k in range(120):
        edited = list(base if k % 3 else other)
        for place in rng.sample(range(100), rng.choice([1, 2, 6])):
            edited[place] = f"z{rng.randint(0, 30)}"
        rows.append((k, " ".join(edited)))
    shape = near_dups.Shape(bands=256, rows=1)
    found = near_dups.near_duplicates(documents(spark, rows), shape).collect()
    assert {r.doc_id: r.component_id for r in found} == classes(rows)


def test_one_row_of_a_class_stays(spark):
    long = " ".join(f"w{k}" for k in range(40))
    near = long + " and"
    rows = [(7, long)] * 300 + [(9, near)] * 5 + [(3, "alone here")] * 4 + [(None, "no id at all")] * 6
    rows += [(2, None)] * 3 + [(2, "")] * 2 + [(None, "")] * 2 + [(None, None)]
    twice = " ".join(f"v{k}" for k in range(40))
    rows += [(20, twice), (20, twice + " more"), (21, "y z")]
    table = documents(spark, rows).selectExpr("*", "1 AS __row", "2 AS kept")
    kept = near_dups.drop_near_duplicates(table)
    assert kept.columns == table.columns
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    many = [key for key in got if key[0] == 20]
    assert len(many) == 1 and got.pop(many[0]) == 1
    expected = {(7, long): 1, (3, "alone here"): 1, (None, "no id at all"): 1, (2, None): 1, (2, ""): 1, (21, "y z"): 1}
    assert got == expected | {(None, ""): 2, (None, None): 1}


def test_signature_estimates_similarity():
    import numpy as np

    rng = np.random.default_rng(2)
    shared, a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (3000, 500, 500))
    sets = np.concatenate([shared, a, shared, b])
    shape = near_dups.Shape(bands=100, rows=8)
    one, two = near_dups.signatures(sets, np.array([0, 3500, 7000]), shape)
    assert abs((one == two).mean() - 0.75) < 0.06


def test_odd_and_empty_near_duplicates(spark):
    found = near_dups.near_duplicates(documents(spark, odd_texts(), extra=True)).collect()
    assert len(found) == len(odd_texts())
    by_id = {r.doc_id: r for r in found if r.doc_id is not None}
    assert by_id[4].component_id == 4 and by_id[4].kept and by_id[1].kept and by_id[3].n_shingles == 0
    assert by_id[5].n_shingles == 1 and by_id[6].n_shingles == 1
    assert [r.component_id for r in found if r.doc_id is None and r.n_shingles] == [4]
    assert near_dups.near_duplicates(documents(spark, [])).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(200)] + [(500, k) for k in range(501, 700)] + [(900, 900)]
    links = spark.createDataFrame(edges, "a long, b long")
    found = {r.node: r.component for r in components.connected(links, Scratch(spark, "test")).collect()}
    assert all(found[k] == 0 for k in range(201)) and all(found[k] == 500 for k in range(500, 700))
    assert components.connected(links.where("a < 0"), Scratch(spark, "test")).count() == 0


# -- line dedup --------------------------------------------------------------------


def lined(seed, n=120, k=12):
    rng = random.Random(seed)
    pool = [" ".join(words(rng, rng.randint(1, 14))) for _ in range(k)] + ["", "  "]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randint(0, 25))) for _ in range(n)]
    texts += [texts[0], texts[1] + "\nnew line", "same line\n" * 60]
    return list(enumerate(texts))


@pytest.mark.parametrize("least", [10, 50])
def test_removed_lines_match_all_runs(spark, least):
    rows = lined(least)
    table = documents(spark, rows, extra=True)
    found = line_dedup.dedup_lines(table, least)
    assert found.columns == [*table.columns, "removed_lines"]
    texts = dict(rows)
    expected = deduped(rows, least)
    for r in found.collect():
        assert r.removed_lines == expected[r.doc_id]
        lines = texts[r.doc_id].split("\n")
        assert r.text == "\n".join(x for k, x in enumerate(lines) if k not in set(expected[r.doc_id]))
    assert any(expected.values())


def test_line_dedup_runs_no_python(spark):
    plan = line_dedup.dedup_lines(documents(spark, lined(3)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_odd_and_empty_line_dedup(spark):
    rows = [*odd_texts(), (7, "y " * 60), (8, "y " * 60), (8, "y " * 60), (None, "y " * 60)]
    found = line_dedup.dedup_lines(documents(spark, rows, extra=True)).collect()
    assert len(found) == len(rows)
    assert [r.text for r in found if r.doc_id == 7] == ["y " * 60]
    assert [r.text for r in found if r.doc_id == 8] == ["", ""]
    assert sorted((r.text or "") for r in found if r.doc_id is None) == ["", "", "a b c"]
    assert line_dedup.dedup_lines(documents(spark, [])).count() == 0


# -- urls --------------------------------------------------------------------------


def plain_url(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
    fits = []
    for verdict, rule in url_filter.RULES:
        domain, start = rule.split("/", 1)
        if (host == domain or host.endswith("." + domain)) and path.startswith("/" + start):
            fits.append((len(rule), rule, verdict))
    return host, path, max(fits, default=None)


URLS = [
    "https://a.example.net/en/1", "http://example.net/EN/1", "https://EXAMPLE.com/de/x?y#z", "http://x.example.com/de",
    "http://b.org/fr/", "http://borg/fr/", "http://org/fr/1", "http://notnet/", "http://net", "http://net/", "http://net?/x",
    "x://y://z.net/p", "no url", "", None, "http://İ.net/ß\n/q", "http://casino-spam.example.org/en/spin", "http:///path/only",
    "http://user@Host.NET:80/x", "http://library.example.org/en/history",
]


def test_urls_match_plain_rules(spark):
    table = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").selectExpr("*", "'x' AS host", "1 AS label", "2 AS features")
    rows = {r.page_id: r for r in url_filter.judge_urls(table).collect()}
    for k, url in enumerate(URLS):
        host, path, fit = plain_url(url)
        assert (rows[k].host, rows[k].path) == (host, path), url
        assert rows[k].rule == (fit[1] if fit else None)
        assert rows[k].verdict == (fit[2] if fit else ("block" if rows[k].score >= 0.5 else "allow"))
    assert rows[16].verdict == "block" and rows[19].verdict == "allow"
    assert url_filter.judge_urls(table.limit(0)).count() == 0


def test_url_model_on_urls_it_has_not_seen(spark):
    unwanted = ["https://mega-casino.example.org/win", "http://spam-mail.example.com/buy", "https://poker-jackpot.example.net/x"]
    wanted = ["https://blog.therer.example.org/en/9", "http://www.city-library.example.com/books", "https://m.science.example.org/fr/7"]
    table = spark.createDataFrame([(u,) for u in unwanted + wanted], "url string").selectExpr("url AS page_id", "url")
    rows = {r.page_id: r.score for r in url_filter.judge_urls(table, rules=()).collect()}
    assert min(rows[u] for u in unwanted) > 0.5 > max(rows[u] for u in wanted)


def test_url_filter_runs_no_python(spark):
    table = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    plan = url_filter.judge_urls(table)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# -- quotes ------------------------------------------------------------------------

CHAT = "conv_id long, turn long, role string, text string"
MESSAGES = [
    (1, 0, "user", "How do I sort a table?\nIt is large."),
    (1, 1, "assistant", "Use a range partition.\n\nThen sort each part."),
    (1, 2, "user", "Something else:\nwhat is salting?"),
    (1, 3, "assistant", "On Monday X wrote:\n> How do I  SORT\n> a table?\nDone already."),
    (1, 4, "user", "> > Use a range partition.\n> unknown words\n>> Then sort each part.\nThanks!"),
    (1, 5, "user", "> Something else:\n> what is salting?\n> > It is large.\nNo > quote here"),
    (2, 0, "user", "It is large."),
    (2, 5, "assistant", "> It is large.\nyes"),
    (2, 7, "assistant", "after a gap"),
    (None, 1, "user", "> It is large.\nlost"),
    (3, None, None, None),
]


def test_quotes_are_linked_and_taken_out(spark):
    table = spark.createDataFrame(MESSAGES, CHAT).selectExpr("*", "1 AS depth", "2 AS lines", "3 AS level")
    rows = {(r.conv_id, r.turn): r for r in quotes.link_quotes(table).collect()}
    assert len(rows) == len(MESSAGES)
    assert [(rows[1, t].reply_to, rows[1, t].by_quote) for t in range(6)] == [
        (None, False), (0, False), (1, False), (0, True), (1, True), (2, True),
    ]
    assert [rows[1, t].depth for t in range(6)] == [0, 1, 2, 1, 2, 3]
    assert all(rows[1, t].root_turn == 0 for t in range(6))
    assert rows[1, 3].own_text == "Done already." and rows[1, 4].own_text == "Thanks!"
    assert rows[1, 5].own_text == "No > quote here" and rows[1, 5].quote_depth == 2
    assert rows[1, 3].formatted == "<|assistant|>\nDone already."
    assert (rows[2, 5].reply_to, rows[2, 7].reply_to, rows[2, 7].depth) == (0, None, 0)
    assert rows[None, 1].own_text == "lost" and rows[None, 1].reply_to is None and rows[3, None].own_text == ""


def test_long_chains_of_replies(spark):
    table = spark.createDataFrame([(1, k, "user", f"m{k}") for k in range(300)] * 2, CHAT)
    rows = quotes.link_quotes(table).collect()
    assert len(rows) == 600 and all(r.depth == r.turn and r.root_turn == 0 for r in rows)
    assert quotes.link_quotes(table.limit(0)).count() == 0


def test_random_quotations_find_their_message(spark):
    rng = random.Random(7)
    rows, truth = [], {}
    for conv in range(30):
        told = []
        for turn in range(8):
            own = "\n".join(" ".join(words(rng, rng.randint(2, 9))) for _ in range(rng.randint(1, 4)))
            text = own
            if told and rng.random() < 0.7:
                source = rng.randrange(len(told))
                lines = told[source].split("\n")
                a = rng.randrange(len(lines))
                quoted = lines[a : a + rng.randint(1, 3)]
                text = "\n".join("> " + x.upper() for x in quoted) + "\n" + own
                truth[conv, turn] = source
            told.append(own)
            rows.append((conv, turn, "user", text))
    found = {(r.conv_id, r.turn): r for r in quotes.link_quotes(spark.createDataFrame(rows, CHAT)).collect()}
    for key, r in found.items():
        assert r.by_quote == (key in truth)
        assert r.reply_to == truth.get(key, key[1] - 1 if key[1] else None)


def test_wrapped_and_partial_quotations_find_their_message(spark):
    rng = random.Random(31)
    wrap = lambda text, n: [" ".join(text.split()[i : i + n]) for i in range(0, len(text.split()), n)]
    rows, truth = [], {}
    for conv in range(24):
        own = []
        for turn in range(4):
            paragraphs = ["\n".join(" ".join(words(rng, 11)) for _ in range(3)) for _ in range(3)]
            own.append("\n\n".join(paragraphs))
            rows.append((conv, turn, "user", own[-1]))
        own.append("It is so. Seven apples fell! Who saw them fall? Nobody there did.")
        rows.append((conv, 4, "user", own[-1]))
        source = rng.randrange(3)
        parts = own[source].split("\n\n")
        kind = conv % 4
        if kind == 0:  # two of three paragraphs, wrapped anew
            quoted = wrap(parts[0], 7) + [""] + wrap(parts[1], 7)
        elif kind == 1:  # some lines of a paragraph, wrapped anew
            quoted = wrap(" ".join(parts[1].split("\n")[1:]), 4)
        elif kind == 2:  # from the middle of a line to the middle of another
            quoted = wrap(" ".join(parts[2].split()[5:25]), 6)
        else:  # two short sentences out of a line, the first wrapped
            quoted, source = ["Seven apples", "fell! Who saw them fall?"], 4
        lines = "\n".join("> " + x for x in quoted)
        rows += [(conv, 5, "user", "Something between."), (conv, 6, "user", f"{lines}\nAnswer.")]
        rows.append((conv, 7, "user", "> these words stand nowhere before in what was said\nAnswer."))
        truth[conv] = source, len([x for x in quoted if x])
    found = {(r.conv_id, r.turn): r for r in quotes.link_quotes(spark.createDataFrame(rows, CHAT)).collect()}
    assert len(found) == len(rows)
    for conv, (source, n) in truth.items():
        r = found[conv, 6]
        assert (r.reply_to, r.by_quote, r.own_text) == (source, True, "Answer."), (conv, r)
        assert 1 <= r.n_linked_lines and (found[conv, 7].reply_to, found[conv, 7].by_quote) == (6, False)
        assert conv % 4 == 3 or r.n_linked_lines >= n


# -- pipeline ----------------------------------------------------------------------


def pipeline_tables(spark, tmp_path):
    rng = random.Random(21)
    common = ["the", "of", "and", "to", "in"]
    draw = lambda n: " ".join(rng.choice(common) if rng.random() < 0.4 else f"{rng.choice('bcdfg')}{rng.randint(0, 3000)}" for _ in range(n))
    docs = [(k, "\n".join(draw(30) for _ in range(4)), "en", "s", 1) for k in range(200)]
    docs.append((200, docs[5][1], "en", "s", 1))  # an exact copy: nothing is left of it
    near = docs[6][1].split(" ")
    near[7], near[60], near[95] = "other", "some", "else"  # every line but one differs
    near = " ".join(near).replace("\n", " ")
    docs.append((201, near, "en", "s", 1))
    docs.append((202, "too short", "en", "s", 1))
    docs.append((203, None, None, "s", 0))
    passage = draw(60)
    docs.append((204, draw(70) + "\n" + passage, "en", "s", 1))
    docs.append((205, draw(70) + "\n" + passage + "\n" + draw(10), "en", "s", 1))
    item = draw(20)
    docs.append((206, draw(60) + " " + item, "en", "s", 1))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return {d[0]: d[1] for d in docs}, passage


def test_line_stage_gives_back_a_column_of_the_operators_name(spark):
    import corpus_pipeline

    run = "\n".join(" ".join(f"w{k}{j}" for j in range(20)) for k in range(4))
    docs = documents(spark, [run, "before\n" + run, "other"]).selectExpr("*", "'mine' AS removed_lines")
    rows = corpus_pipeline.line_dedup(spark, docs, "").orderBy("doc_id").collect()
    assert [(r.text, r.removed_lines) for r in rows] == [(run, "mine"), ("before", "mine"), ("other", "mine")]
    assert rows[0].asDict().keys() == dict.fromkeys(docs.columns).keys()


def test_pipeline_stage_by_stage(spark, tmp_path):
    import corpus_pipeline

    texts, passage = pipeline_tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, gone = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in docs.collect()}
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == columns
        gone.append(sorted(before - {r.doc_id for r in docs.collect()}))
    assert gone == [[202, 203], [200], [201], [206]]
    left = {r.doc_id: r for r in docs.collect()}
    assert passage in left[204].text and passage not in left[205].text
    assert left[205].n_chars == len(left[205].text) == len(texts[205]) - len(passage) - 1
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} == set(left)
