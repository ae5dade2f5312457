from skillgauge.llm import quotes

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth string, message int"
FIRST = "Hello all,\n\nshall we meet\non Monday?\n\nBring cake.\nBring tea."
MESSAGES = [
    (1, 0, "user", FIRST),
    (1, 1, "other", "On Sunday, X wrote:\n> Shall we meet on\n> monday?\n\nYes, noon suits me."),
    (1, 2, "user", "> yes noon suits me\n>\n>> shall we meet on Monday\n\nGood."),
    (1, 3, "third", "> Bring cake.\nWhich cake?"),
    (1, 4, "user", "No quote here"),
    (2, 0, "user", "> Which cake?\nA large one."),
    (2, 1, "user", "> nobody ever said this\nfine"),
    (3, 0, None, None),
    (None, 0, "user", "> good\nfrom outside"),
    (None, 5, "user", "alone"),
    (4, 0, "user", "> > deep\n> > quote"),
    (4, 1, "user", "> from the future\nnow"),
    (4, 2, "user", "from the future"),
]


def frame(spark, rows=MESSAGES):
    return spark.createDataFrame([(*row, "d", 1) for row in rows], SCHEMA)


def found(df):
    return {(r["conv_id"], r["turn"]): r for r in df.collect()}


def test_replies_follow_quotes(spark):
    rows = found(quotes.linked_conversations(frame(spark)))
    parent = {key: (r["parent_conv"], r["parent_turn"]) for key, r in rows.items()}
    assert parent[1, 1] == (1, 0)
    assert parent[1, 2] == (1, 1)
    assert parent[1, 3] == (1, 0)
    assert parent[1, 4] == (1, 0)
    assert parent[2, 0] == (1, 3)
    assert parent[2, 1] == (2, 0)
    assert parent[4, 1] == (4, 0)
    assert parent[3, 0] == parent[None, 5] == parent[4, 0] == (None, None)
    depth = {key: r["depth"] for key, r in rows.items()}
    assert (depth[1, 0], depth[1, 1], depth[1, 2], depth[2, 0], depth[2, 1], depth[3, 0]) == (0, 1, 2, 2, 3, 0)
    assert (rows[2, 1]["root_conv"], rows[2, 1]["root_turn"]) == (1, 0)
    assert rows[1, 2]["n_quoted"] == rows[1, 2]["n_linked"] == 2


def test_texts_lose_their_quotes(spark):
    rows = found(quotes.linked_conversations(frame(spark)))
    assert rows[1, 0]["clean_text"] == FIRST
    assert rows[1, 1]["clean_text"] == "Yes, noon suits me."
    assert rows[1, 2]["clean_text"] == "Good."
    assert rows[4, 0]["clean_text"] == rows[3, 0]["clean_text"] == ""


def test_long_reply_chains(spark):
    chain = [(7, k, "u", (f"> reply number {k - 1}\n" if k else "") + f"reply number {k}") for k in range(70)]
    rows = found(quotes.linked_conversations(frame(spark, chain)))
    assert [rows[7, k]["depth"] for k in range(70)] == list(range(70))
    assert all(r["root_turn"] == 0 for r in rows.values())


def test_repeated_rows_and_empty_table(spark):
    doubled = MESSAGES + MESSAGES
    once = quotes.linked_conversations(frame(spark)).collect()
    assert sorted(map(str, quotes.linked_conversations(frame(spark, doubled)).collect())) == sorted(map(str, once * 2))
    assert quotes.linked_conversations(frame(spark, [])).count() == 0
