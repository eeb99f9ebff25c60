import pytest

from spoofscope.llm import licenses

FILL = " ".join(f"word{i}" for i in range(100))


def run(df, **kw):
    return {(r.doc_id, r.license_id): r for r in licenses.found(df, **kw).collect()}


def test_notices_are_found_anywhere(docs_of):
    texts = [f"{FILL[:k]} {n} {FILL}" for k in (0, 50, 333) for n in licenses.NOTICES.values()]
    got = run(docs_of([*texts, FILL, None, "", "MIT License"]))
    names = list(licenses.NOTICES)
    assert set(got) >= {(i, names[i % len(names)]) for i in range(len(texts))}
    assert not {i for i, _ in got} & set(range(len(texts), len(texts) + 4))


def test_containment_decides(docs_of):
    notice = {"n": " ".join(f"t{i}" for i in range(24))}  # 20 runs
    words = notice["n"].split()
    near, far = " ".join([*words[:20], "x", *words[21:]]), " ".join([*words[:12], "x", *words[13:]])
    got = run(docs_of([f"{FILL} {t} {FILL}" for t in (notice["n"], near, far)]), notices=notice)
    assert {k: r.containment for k, r in got.items()} == {(0, "n"): 1000, (1, "n"): 800}
    assert got[0, "n"].first_word == 100


def test_bands_meet_the_guarantee():
    for size in (1, 2, 4, 8, 16, 32):
        t = size // 2 + 1
        j = .8 * t / (2 * size + t - .8 * t)
        assert (1 - j) ** licenses.bands_for(size) <= licenses.MISS


def test_repeated_rows_nulls_and_empty_table(docs_of, empty_docs):
    text = licenses.NOTICES["MIT"]
    got = run(docs_of([(1, text), (1, text), (None, text)]))
    assert set(got) == {(1, "MIT"), (None, "MIT")}
    assert licenses.found(empty_docs).count() == 0
    with pytest.raises(ValueError):
        licenses.found(docs_of([text]), notices={"short": "two words"})
