from test_subjects import WORDS, corpus

from rankloom.llm import subjects as S


def test_applicants_of_few_labels_have_an_outcome():
    rows = [(t, "src", f"{sorted(y)[0]} works {i % 40}", y) for i, (t, _, _, y) in enumerate(corpus(200, 6))]
    model = S.fit(rows, list(WORDS))
    assert set(model.lifts["address"]) == {a for _, _, a, _ in rows}
    lift = S._lifts([("", "", "one", frozenset(["optics"])), ("", "", "two", frozenset(["energy"]))], 2, list(WORDS))
    assert lift["one"].tolist() == [0.5, 1.5, 0.0] and set(lift) == {"one", "two"}
    at, x = model.outcomes([rows[0][0]], ["src"], [rows[0][2]])
    assert at.tolist() == [0] and x[0, :, 6].max() > 0
