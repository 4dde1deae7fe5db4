import unicodedata

from pyspark.sql import functions as F

from disclore.functions import chunks, jsons, text, vectors
from disclore.functions.classify import category, classified
from disclore.functions.html import form_fields, html_text


def one(spark, expr, *values, names="abcdef", schema=None):
    row = spark.createDataFrame([values], schema or ", ".join(f"{n} string" for n in names[: len(values)]))
    return row.select(expr.alias("x")).first()["x"]


def test_points_maqaf_and_blanks_go(spark):
    raw = "שָׁלוֹם־עולם \x1c  טוב"
    gone = {chr(c) for c in range(0x591, 0x5C8)}
    plain = " ".join("".join(c for c in unicodedata.normalize("NFC", raw) if c not in gone).split())
    assert one(spark, text.strip_points(F.col("a")), raw) == plain


def test_footer_goes_by_priority_not_place(spark):
    raw = f"head\n{text.START_MARKER} 1\n\n  body \n{text.FOOTERS[1]} x\n mid\n{text.FOOTERS[0]} y"
    assert one(spark, text.trim_report(F.col("a")), raw) == f"{text.START_MARKER} 1\nbody\n{text.FOOTERS[1]} x\nmid"


def test_form_symbol_window(spark):
    for at, found in ((196, "ת121"), (197, None)):
        assert one(spark, text.form_symbol(F.col("a")), "x" * at + "ת121") == found


def test_normaliser_and_variants(spark):
    assert one(spark, text.normalise_hebrew(F.col("a")), "a\t b\r\n• item  \n\n\nשלום\n5 é") == "a b\n- item\nשלום 5"
    assert one(spark, text.clean_extracted(F.col("a")), "One.\nTwo\nthree  é") == "One.\nTwo three"
    assert one(spark, text.first_line(F.col("a")), "\n  \n x \ny") == "x"
    assert one(spark, text.strip_fence(F.col("a")), '```json\n{"a": 1}\n```') == '{"a": 1}'
    assert one(spark, text.escape_inner_quotes(F.col("a")), 'בע"מ "x"') == 'בע\\"מ "x"'
    assert one(spark, text.short_number(F.col("a").cast("double")), "12.500") == "12.5"
    assert one(spark, text.short_number(F.col("a").cast("double")), "300") == "300"


def test_lists_of_numbers(spark):
    assert one(spark, text.ints_of(F.col("a")), "1, 2") == [1, 2]
    assert one(spark, text.ints_of(F.col("a")), "10, 21,132 ,0") == [10, 21, 132, 0]
    assert one(spark, text.ints_of(F.col("a")), "1,x") == []
    assert one(spark, text.ints_of(F.col("a"), True), "1,x") == ["1", "x"]
    assert one(spark, text.ints_of(F.col("a"), True), " ") is None


def test_char_chunks_at_the_edges(spark):
    for n in (0, 1, 1200, 1201, 1500, 1501):
        t = "".join(chr(97 + i % 26) for i in range(n))
        assert one(spark, chunks.char_chunks(F.col("a")), t) == [t[i : i + 1500] for i in range(0, n, 1200)]


def test_paragraph_chunks_like_a_plain_loop(spark):
    def plain(t, most):
        out, now = [], ""
        for line in t.split("\n"):
            if len(now) + len(line) < most:
                now += line + "\n"
            else:
                out.append(now.strip())
                now = line + "\n"
        return out + ([now.strip()] if now else [])

    for t in ("", "abc", "x" * 50, "a\nb\nc" * 9, "x" * 12 + "\n" + "y" * 3):
        assert one(spark, chunks.paragraph_chunks(F.col("a"), 10), t) == plain(t, 10)


def test_rules(spark):
    cases = [
        ("ת076", "", "", "CORP_INSIDER_HOLDINGS"), ("ת121", "", "Zoom", "CORP_INVESTOR_RELATIONS"), ("ת121", "602", "x", "MGMT_OFFICER_CHANGE"), ("ת121", "707", "דיבידנד", "FIN_CAPITAL_STRUCTURE"),
        ("x", " 602", "", "CORP_MISC_UPDATE"), ("x", "201", "פסק דין", "CORP_MATERIAL_EVENTS"), ("x", "602,1", "סדר יום", "CORP_HOLDER_MEETINGS"), ("א121", "", "", "NEW_CANDIDATE_BOND_TRUSTEE_CHANGE"),
    ]
    for f, e, t, want in cases:
        assert one(spark, category(F.col("a"), F.col("b"), F.col("c")), f, e, t) == want
    df = spark.createDataFrame([(1, None, "", "x ת097"), (2, "", "", "x ת097"), (3, None, "", "x")], "doc_id int, form_type string, eventIds string, text string")
    rows = {r["doc_id"]: r for r in classified(df).collect()}
    assert rows[1]["category_handle"] == "MGMT_OFFICER_CHANGE" and rows[1]["form_type"] == "ת097"
    assert rows[2]["classification_status"] == rows[3]["classification_status"] == "Error: Form symbol not found."


def test_json_helpers(spark):
    typed = '{"M":{"event":{"L":[{"M":{"eventId":{"N":"201"},"eventName":{"S":"x"}}}]}}}'
    assert one(spark, jsons.unwrap_typed(F.col("a")), typed) == '{"event": [{"eventId": 201, "eventName": "x"}]}'
    assert one(spark, jsons.event_ids(F.col("a")), typed) == [201]
    assert one(spark, jsons.event_names(F.col("a")), typed) == ["x"]
    for bad in ("[1]", "{}", "{x", None):
        assert one(spark, jsons.object_keys(F.col("a")), bad) is None


def test_replies(spark):
    from disclore.operators.assist import parse_reply

    for r, want in {
        '```json\n{"cluster_id": 3, "confidence": 4}\n```': (3, ""), '{"cluster_id": 3, "confidence": 3}': (None, ""), '{"cluster_id": "NEW_CLUSTER", "title": " T "}': (None, "T"), 'x "cluster_id": 7, "confidence": 2': (None, ""), 'x "cluster_id": "8"': (8, ""),
        'x "cluster_id": "NEW_CLUSTER", "title": "A b"': (None, "A b"), "5. title": (5, ""), 'NEW_CLUSTER: "N"': (None, "N"), "nothing": (None, ""),
    }.items():
        x = one(spark, jsons.cluster_reply(F.col("a")), r)
        assert (x["cluster_id"], x["title"]) == want == parse_reply(r), r


def test_entities(spark):
    assert one(spark, html_text(F.col("a")), "<p>&#1488;&rsquo;&ndash;&eacute; &lt;b&gt;&nbsp;&amp;amp; &#x5d0;</p>") == "א’–é <b> &amp; א"


def test_form_fields(spark):
    h = '<span id="HeaderFormNumber"> ת121 </span><span>ab</span><span>abc</span><span>__abc</span><textarea> long text </textarea><table><tr><td>k</td><td>v</td><td>x</td></tr><tr><td>k</td></tr></table>'
    f = one(spark, form_fields("a"), h)
    assert f["form_type"] == "ת121" and f["subject"] is None and f["body"] == "abc\nlong text" and f["table_text"] == "k: v"


def test_zero_vectors(spark):
    assert one(spark, vectors.l2_normalised(F.col("a")), [0.0, 0.0], schema="a array<double>") == [0.0, 0.0]
    assert one(spark, vectors.cosine_distance(F.col("a"), F.col("a")), [0.0, 0.0], schema="a array<double>") == 1.0


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_tokens_are_split_once_a_row(spark):
    df = spark.createDataFrame([("a b  c d e",), ("",), (" x ",), (None,)], "a string").select(chunks.token_chunks(F.col("a"), 2, 3).alias("x"))
    assert [r["x"] for r in df.collect()] == [["a b", "c d", "e"], [], ["x"], None]
    lazy = spark.range(1).select(chunks.token_chunks(F.concat(F.col("id").cast("string"), F.lit(" b")), 2, 3).alias("x"))
    assert plan_of(lazy).count("split(") == 1
