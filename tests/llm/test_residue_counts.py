from scrivane.llm import residue

ORDINARY = "The client liked the layout of report {} about turbines, valves and harvests near the river."
TITLE = "Dummy text client layout"


def test_weights_are_counted_in_all_rows_of_the_table(spark):
    """Words that are rare elsewhere but common in this table's texts weigh little in it."""
    rows = [TITLE] + [ORDINARY.format(k) for k in range(2000)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    assert residue.label(TITLE, residue.background()) is None
    assert [tuple(r) for r in residue.residue(df).collect()] == [(0, "filler")]


def test_counts_leave_out_residue(spark):
    rows = ["Lorem ipsum dolor sit amet, consectetur adipiscing elit."] * 50 + [ORDINARY.format(k) for k in range(30)] + [None, " "]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").where("text is not null").repartition(3)
    found = {}
    for r in residue._scanned(df).where("n is not null").collect():
        found[r.text] = found.get(r.text, 0) + r.n
    assert (found[""], found["client"], found.get("ipsum", 0)) == (30, 30, 0)


def test_a_text_that_is_residue_is_possible():
    index = residue.background()
    for text in ("Dear {{ name }},", "Access denied.", "Hier steht ein Blindtext.", "Lorem ipsum dolor sit amet, sed do eiusmod", "(add your phone here)"):
        assert residue.label(text, index) and residue.possible(text, residue._words(text), index)
    assert not residue.possible(ORDINARY, residue._words(ORDINARY), index)
