import random
from itertools import combinations

from panelspark.llm.catalog import QUERIES
from panelspark.llm.decontaminate import EQUAL, MASKS, WINDOW, contaminated, token_codes, without_contaminated


def tokens(text):
    return token_codes((text or "").lower().encode()).tolist()


def held(doc, item):
    d, t = tokens(doc), tokens(item)
    w = min(WINDOW, len(t))
    if len(t) < 5:
        return False
    need = EQUAL if len(t) >= WINDOW else len(t)
    return any(sum(a == b for a, b in zip(d[i:i + w], t[k:k + w])) >= need for i in range(len(d) - w + 1) for k in range(len(t) - w + 1))


def test_masks_find_every_pair_of_substitutions():
    for miss in combinations(range(WINDOW), WINDOW - EQUAL):
        assert any(all(s + k not in miss for k in m) for m in MASKS for s in range(WINDOW - m[-1]))


def test_query_equals_all_alignments(spark, folder, texts):
    items = [(r.item_id, tokens(r.text)) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    want = set()
    for d, text in texts.items():
        doc = tokens(text)
        places = {}
        for i, t in enumerate(doc):
            places.setdefault(t, []).append(i)
        for item, t in items:
            best, hits = set(), {}
            for k, x in enumerate(t):
                for i in places.get(x, ()):
                    hits.setdefault(i - k, []).append(k)
            for shift, ks in hits.items():
                if any(ks[n + EQUAL - 1] - ks[n] < WINDOW and max(0, -shift, ks[n + EQUAL - 1] - WINDOW + 1) <= ks[n]
                       and min(len(t), len(doc) - shift) - max(0, -shift) >= WINDOW for n in range(len(ks) - EQUAL + 1)):
                    best.add(shift)
            if best:
                want.add((d, item))
    assert {(r.doc_id, r.item_id) for r in QUERIES["op1_decontaminate"](spark, folder).collect()} == want and want


def test_substitutions_case_and_short_items(spark):
    rng = random.Random(5)
    letters = "abcdefghijklmnop"
    word = lambda: "".join(rng.choices(letters, k=6))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([30, 13, 13, 7, 5, 4])] + [(6, None), (7, ""), (None, "a b c d e f g")]
    docs = []
    for i, text in items[:6]:
        words = text.split()
        for changed in range(5):
            new = list(words)
            for k in rng.sample(range(len(new)), min(changed, len(new))):
                new[k] = word()
            docs.append(" ".join([word() for _ in range(9)] + new + [word()]))
        docs.append(", ".join(words).upper() + "!")
        docs.append(" ".join(words[2:]))
    table = list(enumerate(docs)) + [(None, docs[0]), (900, None), (901, ""), (902, docs[0] + " " + docs[0]), (902, docs[0])]
    df = spark.createDataFrame(table, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in contaminated(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(d, i) for d, t in table for i, x in items if d is not None and i is not None and x and held(t, x)}


def test_odd_documents(spark, odd_documents, no_documents):
    items = spark.createDataFrame([(1, odd_documents.where("doc_id = 5").first().text)], "item_id long, text string")
    got = {r.doc_id for r in contaminated(odd_documents, items).collect()}
    assert got == {5, 6, 7}
    kept = without_contaminated(odd_documents, items)
    assert kept.columns == odd_documents.columns and kept.count() == 8
    assert contaminated(no_documents, items).count() == 0 and contaminated(odd_documents, items.limit(0)).count() == 0


def test_last_token_ends_the_passage(spark):
    items = spark.createDataFrame([(1, "one two three four five"), (2, " ".join(f"w{k}" for k in range(20)))], "item_id long, text string")
    docs = spark.createDataFrame(
        [(1, "x y one two three four five z"), (2, "a b " + " ".join(f"w{k}" for k in range(20)) + " c")], "doc_id long, text string")
    rows = sorted(contaminated(docs, items).collect())
    assert [(r.doc_id, r.item_id, r.first_token, r.last_token) for r in rows] == [(1, 1, 2, 6), (2, 2, 2, 21)]


def python_steps(node):
    """Most Python steps that run at once in a task of a plan: those of one path without an exchange between them."""
    def walk(n):
        name = n.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(n.executedPlan())
        below = [walk(n.children().apply(k)) for k in range(n.children().size())]
        open_ = 0 if "Exchange" in name else max([x for x, _ in below], default=0) + ("Arrow" in name or "Python" in name)
        return open_, max([open_, *[y for x in below for y in x]])

    return walk(node)[1]


def test_a_task_runs_one_python_worker(spark, folder, odd_documents):
    items = spark.read.parquet(f"{folder}/benchmark.parquet")  # small: by its estimate the other side of the join could be broadcast
    for found in (contaminated(odd_documents, items), without_contaminated(odd_documents, items)):
        plan = found._jdf.queryExecution().executedPlan()
        assert python_steps(plan) == 1 and "BroadcastHashJoin Inner" not in str(plan.toString())
