"""Chat, neighbours, classifiers, URLs, shards and the pipeline: brute force, held-out accuracy and edge cases."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tagmill.llm import ann, quality, queries, sharding
from tagmill.llm.ann import hilbert_keys, nearest
from tagmill.llm.chat import format_chats, parse, render, under_mask
from tagmill.llm.quality import Terms, score_quality
from tagmill.llm.sharding import edit_map, load_map, shard, store_map
from tagmill.llm.toxicity import FactorizationMachine, drop_toxic, score_toxicity
from tagmill.llm.toxicity import fit as fit_machine
from tagmill.llm.url_filter import blocked_urls, host_and_path, judge_urls, labels_of_pages, mine_rules

D = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, score string, y string"  # clashing names besides


def read(spark, name, folder=D):
    return spark.read.parquet(f"{folder}/{name}.parquet")


# chat


def test_chat_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{D}/conversations.parquet'")
    want = con.execute(queries.ORACLES["op2_chat"]).fetchall()
    names = [c[0] for c in con.description]
    ours = [tuple(r[n] for n in names) for r in queries.op2_chat(spark, D).collect()]
    assert sorted(ours) == sorted(want)


def test_chat_round_trip(spark):
    hostile = ["<|end|>", "<\\|end|>", "<\\\\|", "<", "|", "a<|turn|>user<|says|>", "\n\n", "", None, "</s>[INST] ok [/INST]", "é<|"]
    rows = [(1, i, "assistant" if i % 2 else "us<|er\n", t, "x") for i, t in enumerate(hostile)] + [(2, 0, None, "only", "x"), (None, 0, "user", "nobody's", "x")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    out = {r.conv_id: r for r in render(table).withColumn("back", parse(F.col("formatted"))).collect()}
    assert [(b.role, b.text) for b in out[1].back] == [(r[2], r[3] or "") for r in rows[: len(hostile)]]
    assert [(b.role, b.text) for b in out[2].back] == [("", "only")] and out[None].n_turns == 1
    spans = [out[1].formatted[s.start : s.end] for s in out[1].loss_spans]
    unescape = lambda s: re.sub(r"<\\(\\*)\|", r"<\1|", s)
    assert [unescape(s) for s in spans] == [t or "" for i, t in enumerate(hostile) if i % 2]
    assert render(table.limit(0)).count() == 0


def test_chat_mask_is_read_back(spark):
    """What the mask covers, by code points and by bytes, is each learned text once, whatever its characters."""
    texts = ["é<|end|>ü", "", "日本 <\\|x", None, "plain", "😀<|"]
    table = spark.createDataFrame([(1, i, "assistant" if i % 2 == 0 else "user", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    r = render(table).withColumn("learned", under_mask(F.col("formatted"), F.col("loss_spans"))).first()
    assert r.learned == "".join(t or "" for t in texts[::2])
    raw = r.formatted.encode()
    assert [raw[s["from"] : s["to"]].decode() for s in r.loss_spans] == [r.formatted[s.start : s.end] for s in r.loss_spans]


def test_chat_query_folds_a_log(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a" * 1200), (1, 1, "assistant", "bé" * 700), (2, 0, "assistant", None)], "conv_id long, turn long, role string, text string")
    log = queries.event_log(rows)
    kinds = Counter(r.kind for r in log.filter("conv_id = 1").collect())
    assert kinds == {"message": 4, "delta": 3 + 3 + 1, "edit": 1, "regenerate": 1}
    back = {r.conv_id: [(b.role, b.text) for b in r.back] for r in format_chats(log).withColumn("back", parse(F.col("formatted"))).collect()}
    assert back == {1: [("user", "a" * 1200), ("assistant", "bé" * 700)], 2: [("assistant", "")]}


def slow_fold(events):
    """One event after the other."""
    turns, seen = {}, set()
    for e in sorted(events):
        if e in seen:
            continue
        seen.add(e)
        _, turn, kind, role, text = e
        own = turns.setdefault(turn, {"role": "", "text": "", "there": False})
        own["role"] = role or own["role"]
        if kind == "regenerate":
            for t in list(turns):
                if t > turn:
                    turns[t].update(text="", there=False)
        own["text"] = own["text"] + text if kind == "delta" else "" if kind in ("regenerate", "delete") else text
        own["there"] = kind != "delete"
    return [(t["role"], t["text"]) for _, t in sorted(turns.items()) if t["there"]]


def test_chat_fold_equals_one_by_one(spark):
    rng = np.random.default_rng(8)
    logs = {}
    for c in range(40):
        # a turn's first event, and the first after it was taken back, is a message
        events, fresh = [], set()
        for seq in range(30):
            turn = int(rng.integers(5))
            kind = "message" if turn not in fresh else ["message", "delta", "delta", "edit", "regenerate", "delete"][rng.integers(6)]
            fresh = {t for t in fresh if t <= turn} if kind == "regenerate" else fresh
            fresh = fresh - {turn} if kind == "delete" else fresh | {turn}
            events.append((seq, turn, kind, ["user", "assistant"][turn % 2], f"<|{seq}"))
        logs[c] = events + [events[i] for i in rng.integers(0, 30, 6)]
    flat = [(c, *e) for c, events in logs.items() for e in events]
    rng.shuffle(flat)
    frame = spark.createDataFrame([(int(c), int(s), str(k), int(t), str(r), str(x)) for c, s, t, k, r, x in flat], "conv_id long, seq long, kind string, turn long, role string, text string")
    back = {r.conv_id: [(b.role, b.text) for b in r.back] for r in format_chats(frame).withColumn("back", parse(F.col("formatted"))).collect()}
    assert back == {c: f for c, e in logs.items() if (f := slow_fold(e))}


def test_chat_folds_events(spark):
    log = [
        (1, 1, "message", 0, "user", "hello"), (1, 2, "delta", 1, "assistant", "I "), (1, 3, "delta", 1, "assistant", "am"), (1, 4, "message", 2, "user", "what?"), (1, 5, "delta", 3, "assistant", "old"),
        (1, 6, "regenerate", 1, "assistant", None), (1, 7, "delta", 1, "assistant", "I "), (1, 8, "delta", 1, "assistant", "was"), (1, 9, "edit", 0, None, "hi"), (1, 10, "message", 4, "user", "bye"), (1, 11, "delete", 4, None, None),
        (2, 1, None, 0, "user", None),
    ]
    events = spark.createDataFrame(log, "conv_id long, seq long, kind string, turn long, role string, text string")
    back = {r.conv_id: [(b.role, b.text) for b in r.back] for r in format_chats(events).withColumn("back", parse(F.col("formatted"))).collect()}
    assert back == {1: [("user", "hi"), ("assistant", "I was")], 2: [("user", "")]}


# neighbours


def brute(vectors, k):
    ids = np.array(sorted(vectors))
    x = np.array([vectors[i] for i in ids])
    out = {}
    for i in ids[ids % 20 == 0]:
        others = ids != i
        s = x[others] @ np.array(vectors[i])
        order = np.lexsort((ids[others], -s))[:k]
        out[i] = list(zip(ids[others][order].tolist(), s[order].tolist(), strict=True))
    return out


def answers(frame):
    out = defaultdict(list)
    for r in frame.orderBy("query_id", "rank").collect():
        assert r.rank == len(out[r.query_id]) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def test_hilbert_curve_goes_to_neighbours():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        key = hilbert_keys(grid, bits)
        assert len(set(key.tolist())) == len(grid)
        assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


def test_nearest_recall(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 64)  # else the smallest table is one block
    e = read(spark, "embeddings")
    want = brute({r.vec_id: [float(v) for v in r.embedding] for r in e.collect()}, 20)
    got = answers(nearest(e, F.col("vec_id") % 20 == 0))
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)
    for q in want:
        scores = dict(got[q])
        assert [s for _, s in got[q]] == sorted((s for _, s in got[q]), reverse=True)
        assert all(scores[i] == pytest.approx(s, abs=1e-12) for i, s in want[q] if i in scores)


def test_nearest_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    same = [1.0, 2.0, 0.5]
    rows = [(i, same) for i in range(0, 60)] + [(60, [0.0, 0.0, 0.0]), (80, None), (100, [1.0, None, 2.0]), (120, [inf, 1.0, 1.0]), (140, [nan, 1.0, 1.0]), (160, [1.0, 2.0]), (None, same), (61, [3.0, 0.0, 0.0]), (0, same), (180, [-1.0, 0.0, 1.0])]
    table = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")
    got = answers(nearest(table, F.col("vec_id") % 20 == 0))
    assert set(got) == {0, 20, 40, 180}
    assert [i for i, _ in got[0]] == list(range(1, 21)) and [i for i, _ in got[20]] == [*range(20)]
    assert [i for i, _ in got[40]] == [*range(20)] and [i for i, _ in got[180]][:20] == [*range(20)]
    few = answers(nearest(table.filter("vec_id in (180, 61)"), F.col("vec_id") % 20 == 0))
    assert [i for i, _ in few[180]] == [61]
    assert nearest(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_nearest_by_product_not_angle(spark):
    rng = np.random.default_rng(2)
    vectors = {i: (rng.normal(size=8) * rng.uniform(0.2, 5)).astype(np.float32).astype(float).tolist() for i in range(400)}
    got = answers(nearest(spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0))
    want = brute(vectors, 20)
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.9 * 20 * len(want)


# classifiers


def held_out(scored, labels, name):
    joined = scored.filter("held_out").join(labels, "doc_id").select("score", "predicted", name).collect()
    y, s = np.array([r[name] for r in joined]), np.array([r.score for r in joined])
    auc = np.mean((s[y == 1][:, None] > s[y == 0][None]) + 0.5 * (s[y == 1][:, None] == s[y == 0][None]))
    return auc, y, np.array([r.predicted for r in joined]), s


def test_machine_learns_a_pair():
    """Neither term says anything alone; together they do."""
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2, 3000), rng.integers(0, 2, 3000)
    sets = [np.array(sorted({10 + a_, 20 + b_, 30 + n % 7}), np.int32) for n, (a_, b_) in enumerate(zip(a, b, strict=True))]
    m = fit_machine(sets, (a == b).astype(float), buckets=64, rounds=60, rate=0.5, sparsity=0.0)
    score = lambda x, y: m.score(np.array([10 + x, 20 + y]))
    assert min(score(0, 0), score(1, 1)) > 0.7 > 0.3 > max(score(0, 1), score(1, 0))


def test_machine_logit_is_the_sum_over_pairs():
    rng = np.random.default_rng(4)
    m = FactorizationMachine(0.3, rng.normal(size=20), rng.normal(size=(20, 3)))
    t = np.array([1, 4, 7, 13])
    pairs = sum(m.factor[i] @ m.factor[j] for k, i in enumerate(t) for j in t[k + 1 :])
    assert m.logit(t) == pytest.approx(0.3 + m.weight[t].sum() + pairs)


@pytest.fixture(scope="module")
def larger(spark):
    folder = "/root/testdata/sf0.01"
    return read(spark, "documents", folder), read(spark, "labels", folder)


def test_toxicity_held_out(larger):
    docs, labels = larger
    auc, *_ = held_out(score_toxicity(docs, labels), labels, "toxic")
    assert auc > 0.85


def test_quality_held_out(larger):
    docs, labels = larger
    auc, y, predicted, s = held_out(score_quality(docs, labels), labels, "quality")
    assert auc > 0.97 and (y == predicted).mean() > 0.95
    assert abs(s.mean() - y.mean()) < 0.06


@pytest.mark.parametrize(("score", "label"), [(score_toxicity, "toxic"), (score_quality, "quality")])
def test_classifiers_odd_rows(spark, score, label):
    docs = spark.createDataFrame([(i, None if i % 5 == 0 else "good words here" if i % 2 else "bad idiot %%% text", "s", "y") for i in range(40)] + [(None, "x", "s", "y"), (7, "good words here", "s", "y"), (50, "long " * 30000, "s", "y"), (51, "", "s", "y")], DOCS)
    labels = spark.createDataFrame([(i, 1 - i % 2 if i % 7 else None, "a") for i in range(40)] + [(None, 1, "a"), (1, 1, "a"), (999, 0, "a")], f"doc_id long, {label} int, text string")
    rows = score(docs, labels).collect()
    assert len(rows) == 44 and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows if r.doc_id is not None)
    by_doc = {r.doc_id: r.score for r in rows}
    assert [r.score for r in rows if r.doc_id == 7] == [by_doc[7]] * 2
    assert score(docs.limit(0), labels).count() == 0
    assert len({round(r.score, 9) for r in score(docs, labels.limit(0)).collect()}) == 1


def test_quality_against_plain_loops(spark):
    """Neighbour sums, pooling and the network's forward pass, one number at a time; a long text spans blocks."""
    docs = [(1, "Good WORDS, good words 12\nagain again\nx\nx"), (2, None), (3, ""), (4, "one"), (5, " ".join(f"w{i % 50}" for i in range(300_000)))]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    terms = Terms()
    table = {i: terms.of(t).tolist() for i, t in docs}
    places, signs = quality.index_entries()
    want = defaultdict(int)
    for own in table.values():
        for i, t in enumerate(own):
            for j in (i - 2, i - 1, i + 1, i + 2):
                if 0 <= j < len(own):
                    for p, s in zip(places[own[j]].tolist(), signs[own[j]].tolist(), strict=True):
                        want[t, p] += s
    sums = quality.context_sums(quality.term_table(frame))
    assert {(int(t), int(p)): int(sums[t, p]) for t, p in zip(*np.nonzero(sums), strict=True)} == {k: v for k, v in want.items() if v}
    vectors = quality.word_vectors(sums)
    pooled = quality.pool(vectors, np.array(table[1]))
    assert pooled[:-2] == pytest.approx(sum(vectors[t].astype(float) for t in table[1]) / len(table[1]), abs=1e-6)
    assert pooled[-2:] == pytest.approx([np.log(1 + len(table[1])), len(set(table[1])) / len(table[1])])
    rng = np.random.default_rng(0)
    n = vectors.shape[1] + 2
    m = quality.QualityModel(vectors, rng.normal(size=n), rng.uniform(1, 2, n), rng.normal(size=(n, 3)), rng.normal(size=3), rng.normal(size=3), 0.2, 1.7)
    hidden = [np.tanh(sum((pooled[i] - m.mean[i]) / m.scale[i] * m.w1[i, h] for i in range(n)) + m.b1[h]) for h in range(3)]
    z = (sum(hidden[h] * m.w2[h] for h in range(3)) + m.b2) / 1.7
    assert m.score([np.array(table[1])])[0] == pytest.approx(1 / (1 + np.exp(-z)))


def test_labels_of_held_out_rows_do_not_matter(larger):
    docs, labels = larger
    changed = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a = {r.doc_id: r.score for r in score_toxicity(docs, labels).collect()}
    assert a == {r.doc_id: r.score for r in score_toxicity(docs, changed).collect()}


def test_drop_toxic(larger):
    docs, labels = larger
    left = drop_toxic(docs, labels)
    assert left.columns == docs.columns
    scores = {r.doc_id: r.score for r in score_toxicity(docs, labels).collect()}
    assert {r.doc_id for r in left.collect()} == {i for i, s in scores.items() if s < 0.3}


# URLs


def slow_judgement(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
    fits = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    best = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
    return host, path, best and best[1] + best[2], best and best[0]


def test_url_rules(spark):
    odd = [None, "", "no scheme", "http://", "http://COM/", "http://com", "HTTP://A.Example.COM/en/x?y#z", "x://www.example.com/en/", "x://www.example.com/en", "a://b.net/fr/?q", "a://b.net/fr", "a://xnet/fr/", "a://u:p@h.net:80/es/1", "a://b.net?/es/", "a://b.net#/es/", "a://É.Net/es/", "a://b://c.net/es/", "a://b\nc.net/es/"]
    pages = spark.createDataFrame([(i, u, "r") for i, u in enumerate(odd)] + [(None, "a://b.net/es/", "r"), (3, "http://", "r")], "page_id long, url string, rule string")
    none = spark.createDataFrame([], "url string, blocked boolean")
    rows = judge_urls(pages, none).collect()
    assert len(rows) == len(odd) + 2
    for r in rows:
        if r.page_id is not None:
            host, path, rule, verdict = slow_judgement(odd[r.page_id])
            assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or "allow")
    assert judge_urls(pages.limit(0), none).count() == 0


def slow_tokens(url):
    host, path, *_ = slow_judgement(url)
    digits = lambda x: re.sub("[0-9]+", "0", x)
    query = re.search(r"\?([^#]*)", url or "")
    keys = [x.split("=")[0] for x in query.group(1).split("&")] if query else []
    return frozenset([f"h:{digits(x)}" for x in host.split(".") if x] + [f"p:{digits(x)}" for x in re.split("[/.]", path.lower()) if x] + [f"q:{digits(x)}" for x in keys if x])


def slow_mining(labelled, confidence, least):
    """Whether a rule fires, by counting every combination of every blocked URL's tokens."""
    bad, good = Counter(), Counter()
    for url, blocked in labelled:
        has = slow_tokens(url)
        for k in range(1, len(has) + 1):
            for part in combinations(sorted(has), k):
                (bad if blocked else good)[part] += 1
    rules = [set(p) for p, n in bad.items() if n >= least and n / (n + good[p]) >= confidence]
    return lambda url: any(r <= slow_tokens(url) for r in rules)


def test_url_query_against_brute_force(spark):
    urls = {r.page_id: r.url for r in read(spark, "pages").collect()}
    rows = queries.op6_url(spark, D).collect()
    assert len(rows) == len(urls)
    for r in rows:
        host, path, rule, verdict = slow_judgement(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
    pages = read(spark, "pages")
    labelled = [(r.url, r.blocked) for r in labels_of_pages(pages, read(spark, "labels")).collect()]
    fires = slow_mining(labelled, 0.8, 20)
    assert {r.page_id: r.verdict for r in rows} == {i: slow_judgement(u)[3] or ("block" if fires(u) else "allow") for i, u in urls.items()}


def test_mined_rules(spark):
    """Pairs of tokens that mostly go with blocked pages become rules; what fires equals a scan of all rules."""
    rng = np.random.default_rng(0)
    urls = [f"http://h{'abc'[rng.integers(3)]}.org/{'xyz'[rng.integers(3)]}/{'pq'[rng.integers(2)]}?k{rng.integers(2)}=1" for _ in range(1500)]
    bad = [("ha.org" in u and "/x/" in u) != (rng.random() < 0.05) for u in urls]
    labelled = spark.createDataFrame(list(zip(urls, map(bool, bad), strict=True)), "url string, blocked boolean")
    rules = mine_rules(labelled).rules.collect()
    assert [set(r.antecedent) for r in rules] == [{"h:ha", "p:x"}]
    assert all(r.confidence >= 0.8 and r.posted_under in r.antecedent for r in rules)
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    verdicts = {r.page_id: r.verdict for r in judge_urls(pages, labelled).collect()}
    assert all((verdicts[i] == "block") == ("ha.org" in u and "/x/" in u) for i, u in enumerate(urls))
    assert mine_rules(labelled.limit(0)) is None


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mined_verdicts_equal_enumeration(spark, seed):
    """Random URLs with planted and chance combinations; unseen URLs hold some of several tokens that always went together."""
    rng = np.random.default_rng(seed)
    pick = lambda *x: x[rng.integers(len(x))]
    def url():
        keys = "&".join(sorted({pick("a", "b", "c", "d") for _ in range(rng.integers(1, 4))}))
        return f"http://{pick('u', 'v', 'w')}.{pick('org', 'biz')}/{pick('x', 'y')}/{pick('1', '22', 'z')}?{keys}" + ("&tw=1&in=2" if rng.random() < 0.2 else "")
    labelled = [(u, bool(rng.random() < (0.9 if "tw" in u and "/x/" in u or "b&c" in u and "biz" in u else 0.3))) for u in (url() for _ in range(400))]
    fires = slow_mining(labelled, 0.8, 8)
    urls = [url() for _ in range(150)] + ["http://q.org/x/5?tw", "http://q.org/x/5?in=1", "http://q.org/y/5?in", None, "no url"]
    mined = mine_rules(spark.createDataFrame([*labelled, (None, True), ("http://u.org/x", None)], "url string, blocked boolean"), 0.8, 8)
    frame = host_and_path(spark.createDataFrame([(u,) for u in urls], "url string"))
    found = {r.url for r in blocked_urls(frame, mined).collect()}
    assert found == {u for u in urls if u and fires(u)} and found


def test_tokens_that_go_together_are_one_item(spark):
    """Thirty query keys that all labelled URLs share would make 2**30 combinations."""
    keys = "&".join(f"k{chr(97 + i % 26)}{'x' * (i // 26)}" for i in range(30))
    rows = [(f"http://{'abc'[i % 3]}.org/p?{keys}", i % 2 == 0 or i % 3 == 0) for i in range(240)]
    mined = mine_rules(spark.createDataFrame(rows, "url string, blocked boolean"))
    assert [r.antecedent for r in mined.rules.collect()] == [["h:a"]]
    assert mined.items.groupBy("item").count().agg(F.max("count")).first()[0] == 32


def test_rules_need_no_share_of_the_table(spark):
    """Twenty blocked URLs of a host make its rule among 15,000 labelled ones, nineteen don't, nor do 20 of 26."""
    rows = [(f"http://h{'abcde'[i % 5]}.org/{'xyz'[i % 3]}", False) for i in range(15_000)]
    rows += [("http://bad.org/x", True)] * 20 + [("http://few.org/y", True)] * 19 + [("http://mixed.org/z", i < 20) for i in range(26)]
    labelled = spark.createDataFrame(rows, "url string, blocked boolean")
    assert {h for r in mine_rules(labelled).rules.collect() for h in r.antecedent} == {"h:bad"}
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(["http://bad.org/q", "http://few.org/y", "http://mixed.org/z", "http://ha.org/x"])], "page_id long, url string")
    assert [r.verdict for r in judge_urls(pages, labelled).orderBy("page_id").collect()] == ["block", "allow", "allow", "allow"]


def test_labels_of_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.b/en/7.html"), (2, "http://a.b/en/8?x"), (3, "nothing"), (4, "http://a.b/" + "9" * 40), (5, None)], "page_id long, url string")
    labels = spark.createDataFrame([(7, 0, 0), (8, None, 0), (9, None, None)], "doc_id long, quality int, toxic int")
    assert sorted((r.url, r.blocked) for r in labels_of_pages(pages, labels).collect()) == [("http://a.b/en/7.html", True), ("http://a.b/en/8?x", False)]
    assert host_and_path(pages).count() == 5


# shards


def test_sharding(spark, tmp_path):
    docs = read(spark, "documents", "/root/testdata/sf0.01")
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    rows = queries.op7_sharding(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(texts)
    places, sizes, of_slot = defaultdict(list), defaultdict(int), {}
    for r in rows:
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(texts[r.doc_id]) + 8, zlib.crc32(texts[r.doc_id]), "bytes", None)
        places[r.shard].append(r.slot)
        sizes[r.shard] += r.size
        assert of_slot.setdefault(r.virtual_slot, r.shard) == r.shard
    assert sorted(places) == list(range(24)) and all(sorted(v) == list(range(len(v))) for v in places.values())
    mean = sum(sizes.values()) / 24
    assert max(abs(s - mean) for s in sizes.values()) < 0.05 * mean
    # a new shard: slots move into it only, and the map's versions are kept
    records = spark.createDataFrame([(r.virtual_slot, r.size) for r in rows], "virtual_slot int, size long")
    loads = sharding.slot_loads(records)
    first = sharding.first_map(loads, 24)
    second = edit_map(first, loads, 25)
    path = f"file://{tmp_path}/map"
    store_map(first, path)
    store_map(second, path)
    old, new = ({r.virtual_slot: r.shard for r in load_map(spark, path, v).collect()} for v in (1, None))
    moved = {s for s in old if old[s] != new[s]}
    assert set(old) == set(new) and moved and all(new[s] == 24 for s in moved)
    grown = defaultdict(int)
    for r in rows:
        grown[new[r.virtual_slot]] += r.size
    assert max(grown.values()) < 1.2 * sum(grown.values()) / 25 and grown[24] > 0.8 * sum(grown.values()) / 25


def test_stored_map_is_read_and_edited(spark, tmp_path):
    docs, path = read(spark, "documents"), f"file://{tmp_path}/map"
    said = lambda shards: {r.virtual_slot: (r.shard, r.map_version) for r in shard(docs, shards, 512, map_path=path).collect()}
    one, again, grown = said(4), said(4), said(5)
    assert one == again and {v for _, v in one.values()} == {1} and {v for _, v in grown.values()} == {2}
    assert {grown[s][0] for s in one if grown[s][0] != one[s][0]} == {4}
    assert sorted(r.version for r in spark.read.parquet(path).select("version").distinct().collect()) == [1, 2]


def test_a_mass_of_equal_rows_spreads(spark):
    rows = [(7, "same")] * 3000 + [(None, None)] * 2000 + [(i, f"text {i}") for i in range(1000)]
    found = shard(spark.createDataFrame(rows, "doc_id long, text string"), 8, 256).collect()
    assert len(found) == len(rows)
    sizes = Counter()
    for r in found:
        sizes[r.shard] += r.size
    assert max(sizes.values()) - min(sizes.values()) < 0.05 * sum(sizes.values()) / 8


def test_sharding_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "a", 1), (1, None, "a", 1), (None, "x", "a", 1), (2, "", "a", 1), (3, "é" * 200000, "a", 1)], "doc_id long, text string, shard string, slot int")
    rows = shard(docs, 3).collect()
    assert sorted(r.size for r in rows) == [8, 8, 8, 9, 400008]
    for s in range(3):
        own = sorted(r.slot for r in rows if r.shard == s)
        assert own == list(range(len(own)))
    assert shard(docs.limit(0), 3).count() == 0


# pipeline


def test_pipeline_stages_against_brute_force(spark):
    from tagmill.llm.quality_rules import quality_rules

    folder = "/root/testdata/sf0.01"
    docs = read(spark, "documents", folder)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "toxicity", "near_duplicates", "packing"]
    texts = {r.doc_id: r.text for r in docs.collect()}
    one = corpus_pipeline.quality_stage(spark, docs, folder)
    ids = {r.doc_id for r in one.collect()}
    assert ids == {r.doc_id for r in quality_rules(docs).filter("kept").collect()} and one.columns == docs.columns
    two = corpus_pipeline.toxicity_stage(spark, one, folder)
    assert two.columns == docs.columns
    kept = {r.doc_id for r in two.collect()}
    scores = {r.doc_id: r.score for r in score_toxicity(one, read(spark, "labels", folder)).collect()}
    assert kept == {i for i in ids if scores[i] < 0.3}
    from tests.llm.test_text_operators import slow_groups

    three = corpus_pipeline.near_duplicate_stage(spark, two, folder)
    left = {r.doc_id for r in three.collect()}
    assert three.columns == docs.columns
    assert left == {i for i, (_, c) in slow_groups([(i, texts[i]) for i in kept], 5).items() if i == c}
    packed = corpus_pipeline.run(spark, folder).select("doc_id", "length").collect()
    assert {r.doc_id for r in packed} == left




def test_pipeline_on_odd_tables(spark, tmp_path):
    """Nulls in every column, repeated rows, a very long text, clashing extra columns; then no rows at all."""
    docs = [r for r in read(spark, "documents").limit(60).collect()]
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, "x") for r in docs] + [(None,) * 6, (docs[0].doc_id, docs[0].text, None, None, None, None), (900, "", "en", "s", 0, None), (None, docs[1].text, "en", "s", 1, None), (901, " ".join(f"word{i}x{i % 7919}. And" for i in range(200_000)), "en", "s", 1, None)]
    wide = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string")
    labels = spark.createDataFrame([(r.doc_id, i % 2, int(i % 9 == 0)) for i, r in enumerate(docs)] + [(None, None, None)], "doc_id long, quality int, toxic int")
    for name, frame in (("full", wide), ("empty", wide.limit(0))):
        frame.write.parquet(f"file://{tmp_path}/{name}/documents.parquet")
        (labels if name == "full" else labels.limit(0)).write.parquet(f"file://{tmp_path}/{name}/labels.parquet")
    packed = corpus_pipeline.run(spark, f"file://{tmp_path}/full").select("doc_id", "length", "doc_tokens", "start").collect()
    assert packed and 900 not in {r.doc_id for r in packed}
    assert sum(r.length for r in packed if r.doc_id == 901) == next((r.doc_tokens for r in packed if r.doc_id == 901), 0)
    assert corpus_pipeline.run(spark, f"file://{tmp_path}/empty").count() == 0
