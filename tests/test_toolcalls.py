from quarry.operators import toolcalls


def calls(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, call_id string, name string, arguments string")


def test_routes(spark):
    c = calls(spark, [
        (1, 0, "a", "get_information", '{"information": "q?"}'),
        (1, 2, "b", "ask_database", '{"query": "SELECT 1"}'),
        (1, 4, "c", "Answer_generic_questions", '{"message": "hi"}'),
        (1, 6, "d", "foo", '{"message": "x"}'),
        (1, 8, "e", "ask_database", "{bad"),
    ])
    r = {x.call_id: (x.route, x.reply) for x in
         toolcalls.route_tool_call(toolcalls.parse_tool_call(c)).collect()}
    assert r["a"] == ("retrieval", "q?")
    assert r["b"] == ("sql", "SELECT 1")
    assert r["c"] == ("message", "hi")
    assert r["d"] == ("error", "Error: function foo does not exist")
    assert r["e"][0] == "error"


def test_history_grows_per_turn(spark):
    conv = spark.createDataFrame([(1, 0, "user", "u0"), (1, 1, "assistant", "a1"), (2, 0, "user", "v0")],
                                 "conv_id long, turn long, role string, text string")
    h = {(r.conv_id, r.turn): r for r in toolcalls.conversation_history(conv, "S").collect()}
    assert h[(1, 1)].n_messages == 3
    assert [m.content for m in h[(1, 1)].history] == ["S", "u0", "a1"]
    assert [m.content for m in h[(2, 0)].history] == ["S", "v0"]


def test_instructions_left_join(spark):
    c = calls(spark, [(1, 0, "a", "ask_database", "{}"), (1, 2, "b", "foo", "{}")])
    got = {r.call_id: r.instructions for r in
           toolcalls.instructions_lookup(c, toolcalls.instructions_table(spark)).collect()}
    assert got["a"] is not None and got["b"] is None


def test_blocked_history_equals_window_history(spark, sf_small):
    from quarry.sources import tables
    conv = tables.load(spark, sf_small, "conversations")
    a = toolcalls.conversation_history(conv, "S").collect()
    for b in (1, 3, 64):
        got = toolcalls.conversation_history(conv, "S", block_turns=b).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, a))


def test_explode_tool_calls_keeps_order(spark):
    msgs = spark.createDataFrame(
        [(1, 3, [("a", "ask_database", '{"query": "SELECT 1"}'), ("b", "foo", "{}")]), (1, 5, [])],
        "conv_id long, turn long, tool_calls array<struct<id:string,name:string,arguments:string>>")
    rows = toolcalls.explode_tool_calls(msgs).orderBy("call_no").collect()
    assert [(r.turn, r.call_no, r.call_id, r.name) for r in rows] == [(3, 0, "a", "ask_database"), (3, 1, "b", "foo")]
    routed = {r.call_id: r.route for r in
              toolcalls.route_tool_call(toolcalls.parse_tool_call(toolcalls.explode_tool_calls(msgs))).collect()}
    assert routed == {"a": "sql", "b": "error"}


def test_arguments_must_be_one_object_with_the_tools_own_key(spark):
    bad = ["{}", "[1]", '{"query": null}', '{"wrong": "k"}', '{"query": 1}', '{"query": "SELECT 1"} junk',
           '{"query": "SELECT 1"}, {"query": "x"}', '{"query": "x"}], [{}', "{bad", "", "null", None, '"query"']
    rows = [(1, k, str(k), "ask_database", a) for k, a in enumerate(bad)] + [(1, 99, "n", None, '{"query": "x"}'),
                                                                          (1, 98, "ok", "ask_database", ' {"query": "x", "n": 2} ')]
    got = {r.call_id: r for r in toolcalls.route_tool_call(toolcalls.parse_tool_call(calls(spark, rows))).collect()}
    assert len(got) == len(rows) and all(r.reply is not None for r in got.values())
    for k in range(len(bad)):
        assert not got[str(k)].args_ok and got[str(k)].route == "error", bad[k]
    assert got["n"].route == "error" and got["n"].reply == "Error: function without a name does not exist"
    assert (got["ok"].route, got["ok"].reply) == ("sql", "x")


def test_replies_results_and_answers_follow_their_turn(spark):
    conv = spark.createDataFrame([(1, 0, "user", "q")], "conv_id long, turn long, role string, text string")
    c = spark.createDataFrame([(1, 0, 0, "a", "get_information", '{"information": "who?"}'),
                               (1, 0, 1, "b", "ask_database", '{"query": "SELECT 1 AS x"}'),
                               (1, 0, 2, "c", "get_information", '{"information": "why?"}')],
                              "conv_id long, turn long, call_no int, call_id string, name string, arguments string")
    routed = toolcalls.route_tool_call(toolcalls.parse_tool_call(c))
    answers = spark.createDataFrame([("a", "me")], "call_id string, answer string")
    results, _ = toolcalls.sql_tool_answer(spark, routed)
    rows = toolcalls.append_reply(conv, routed, answers, results).orderBy("seq").collect()
    assert [(r.seq, r.role, r.call_id, r.content) for r in rows] == [
        (0, "user", None, "q"), (1, "assistant", "a", "me"), (3, "assistant", "b", "SELECT 1 AS x"),
        (4, "tool", "b", '[{"x":1}]'), (5, "assistant", "c", toolcalls.NO_ANSWER)]


def test_a_large_result_stays_a_table(spark):
    c = spark.createDataFrame([(1, 0, 0, "b", "ask_database", '{"query": "SELECT id FROM range(100)"}')],
                              "conv_id long, turn long, call_no int, call_id string, name string, arguments string")
    routed = toolcalls.route_tool_call(toolcalls.parse_tool_call(c))
    answers, rows = toolcalls.sql_tool_answer(spark, routed, max_result_chars=200)
    assert answers.first().content == "query returned 100 rows"
    assert sorted(r.row_no for r in rows.collect()) == list(range(100))


def test_no_task_gathers_the_history_of_a_whole_conversation(spark):
    conv = spark.createDataFrame([(c, t, "user", f"m{t}") for c, n in ((1, 41), (None, 9), (2, 1)) for t in range(-3, 3 * n, 3)],
                                 "conv_id long, turn long, role string, text string")
    got = toolcalls.conversation_history(conv, "S", block_turns=4)
    assert sorted(got.collect(), key=str) == sorted(
        toolcalls.conversation_history(conv, "S", block_turns=None).collect(), key=str)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.splitlines() if "Window [" in x]
    assert windows
    for w in windows:  # Window [functions], [partition], [order]
        partition = w.split("windowspecdefinition(")[1].split(" ASC")[0]
        assert "collect_list" not in w or "_blk" in partition
