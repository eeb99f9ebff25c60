from spoofscope.llm import lines

COPY = "one a\ntwo b\nthree c"


def run(df):
    return {(r.doc_id, r.n_chars): r for r in lines.without_repeated_lines(df).collect()}


def texts(df):
    return [r.text for r in lines.without_repeated_lines(df).orderBy("doc_id").collect()]


def test_later_occurrences_go_and_overlaps_merge(docs_of):
    got = texts(docs_of([COPY + "\nend", "start\n" + COPY, "x\ny", "one a\ntwo b\nother", COPY + "\nend\nnew"]))
    assert got == [COPY + "\nend", "start", "x\ny", "one a\ntwo b\nother", "new"]


def test_repeats_inside_a_document_and_blank_lines(docs_of):
    df = docs_of([f"{COPY}\n\nmid\n{COPY}", None, "", "\n\n\n", "  \n"])
    got = lines.without_repeated_lines(df).orderBy("doc_id").collect()
    assert got[0].text == f"{COPY}\n\nmid" and (got[0].n_lines, got[0].n_removed, got[0].removed_at) == (7, 3, [5, 6, 7])
    assert [r.text for r in got[1:]] == [None, "", "\n\n\n", "  \n"] and [r.n_lines for r in got[1:]] == [0] * 4


def test_equal_rows_are_one_document_and_ids_may_be_null(docs_of):
    rows = [(1, COPY), (1, COPY), (None, COPY), (2, "p\n" + COPY)]
    got = lines.without_repeated_lines(docs_of(rows)).collect()
    kept = [r.doc_id for r in got if r.n_removed == 0]
    assert kept == [None] and len(got) == 4  # NULL ids order first


def test_empty_table_and_clashing_columns(docs_of, empty_docs):
    assert lines.without_repeated_lines(empty_docs).count() == 0
    df = docs_of([COPY, COPY]).withColumnRenamed("source", "covered").withColumnRenamed("lang", "text_hash")
    got = lines.without_repeated_lines(df)
    assert got.columns[:5] == df.columns and sorted(r.n_removed for r in got.collect()) == [0, 3]


def test_long_text(docs_of):
    long = "\n".join(f"line {i}" for i in range(30_000))
    got = texts(docs_of([long, long + "\nlast"]))
    assert got[0] == long and got[1] == "last"
