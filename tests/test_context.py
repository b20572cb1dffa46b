from quarry.functions import text as T
from quarry.operators import context


def ranked(spark, rows):
    return spark.createDataFrame(rows, "qid long, rank int, text string")


def questions(spark, rows):
    return spark.createDataFrame(rows, "qid long, question string")


def test_prefix_rule_stops_at_first_that_does_not_fit(spark):
    long = " ".join(["x"] * 200)
    r = ranked(spark, [(1, 1, long), (1, 2, "short")])
    q = questions(spark, [(1, "why")])
    kept = context.budget_prefix(r, q, budget=60, intro="Intro.")
    assert kept.count() == 0
    p = context.build_prompt(kept, q, intro="Intro.").first()
    assert p.n_articles == 0 and p.prompt == "Intro.\n\nQuestion: why"


def test_empty_corpus_gives_intro_and_question(spark):
    q = questions(spark, [(1, "what")])
    kept = context.budget_prefix(ranked(spark, []), q)
    assert context.build_prompt(kept, q, intro="I").first().prompt == "I\n\nQuestion: what"


def test_packed_prompt_within_budget_and_next_would_exceed(spark):
    arts = [(1, i + 1, " ".join(["tok"] * 30)) for i in range(10)]
    q = questions(spark, [(1, "q")])
    budget = 150
    kept = context.budget_prefix(ranked(spark, arts), q, budget=budget, intro="Intro")
    p = context.build_prompt(kept, q, intro="Intro")
    row = p.select("n_articles", T.num_tokens("prompt").alias("n")).first()
    assert 0 < row.n_articles < 10 and row.n <= budget
    nxt = row.n + len(arts[0][2].split()) + 7  # article template adds 7 tokens
    assert nxt > budget


def test_chat_request_json(spark):
    p = spark.createDataFrame([(1, "hello")], "qid long, prompt string")
    js = p.select(context.chat_request(p, system="S", model="m").alias("r")).first().r
    assert js == ('{"model":"m","messages":[{"role":"system","content":"S"},'
                  '{"role":"user","content":"hello"}],"temperature":0.0}')


def test_answer_questions_with_stored_vectors_equals_embedding(spark):
    from quarry.operators import embed
    docs = spark.createDataFrame([(1, "red apples and pears"), (2, "blue sky and sea"), (3, "red wine")],
                                 "id long, text string")
    qs = spark.createDataFrame([(10, "red apples")], "qid long, question string")
    a = context.answer_questions(qs, docs, top_n=2).collect()
    vecs = embed.hashed_embedding(docs, "id", "text")
    b = context.answer_questions(qs, docs, top_n=2, corpus_vectors=vecs).collect()
    assert a == b and a[0].n_articles == 2
