import random

from rankloom.llm import subjects as S

WORDS = {"optics": ["lens", "prism", "laser beam", "mirror facet"], "energy": ["battery cell", "turbine", "inverter", "solar panel"], "textiles": ["loom", "yarn guide", "needle", "fabric roll"]}


def document(rnd, subjects, claims=True, noise=None):
    def line(of):
        return f"the {rnd.choice(WORDS[of])} meets the housing near the {rnd.choice(WORDS[of])}."

    own = [subjects[i % len(subjects)] for i in range(8)]
    text = f"Improved {rnd.choice(WORDS[subjects[0]])}\n\nABSTRACT\n" + " ".join(line(s) for s in own[:3])
    text += "\n\nDescription\nThe cover may be formed in one piece. It is known to use a " + rnd.choice(WORDS[noise or subjects[0]]) + "."
    if claims:
        text += "\n\nWhat is claimed is:\n" + "\n".join(f"{i + 1}. A device, wherein {line(s)}" for i, s in enumerate(own))
    return text


def corpus(n, seed):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        subjects = rnd.sample(sorted(WORDS), rnd.choice([1, 1, 1, 2]))
        out.append((document(rnd, subjects, rnd.random() < 0.8, rnd.choice(sorted(WORDS))), "src", None, frozenset(subjects)))
    return out


def test_held_out_accuracy_with_wrong_labels():
    rnd = random.Random(1)
    train, test = corpus(300, 2), corpus(200, 3)
    wrong = [(t, s, a, frozenset([rnd.choice(sorted(WORDS))]) if rnd.random() < 0.05 else y) for t, s, a, y in train]
    model = S.fit(wrong, list(WORDS))
    at, x = model.outcomes([t for t, *_ in test], [s for _, s, *_ in test], [None] * len(test))
    given = dict(zip(at.tolist(), model.choose(x)))
    right = sum(set(given.get(i, [])) == set(r[3]) for i, r in enumerate(test))
    assert right / len(test) > 0.9


def test_sections_with_wrong_headings():
    p = S.sections(S.fold("Title\r\n\r\n(57) Abstract\r\nab\r\n\r\nDescripfion\r\nde\r\n\r\nWhat is c1aimed is:\r\n1. one\r\ncontinued\r\n2. two"))
    assert set(p) == {"title", "abstract", "description", "claims", "first"} and p["first"] == S.fold("1. one\ncontinued")
    bare = S.sections(S.fold("Title\nABSTRACT\nab\n1. one\n2. two"))
    assert bare["claims"] == S.fold("1. one\n2. two") and bare["abstract"] == "ab"
    assert S.sections("") == {}


def test_operator(spark):
    train = corpus(120, 4)
    rows = [(i, t, s, a) for i, (t, s, a, _) in enumerate(train)] + [(900, None, None, None), (901, "", "x", "y"), (902, "\n \t", None, None), (903, "Front page reissued; bibliographic data corrected.", "src", None), (None, train[0][0], None, None)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, applicant string, subject int")
    labels = spark.createDataFrame([(i, s) for i, r in enumerate(train) for s in r[3]] + [(0, sorted(train[0][3])[0]), (None, "optics"), (3, None), (4, "unknown")], "doc_id long, subject string")
    areas = spark.createDataFrame([(s, "t") for s in WORDS] + [(None, "t")], "subject string, subject_title string")
    got = S.assign(docs, labels, areas).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(r.subject)
    assert not {900, 901, 902, 903} & set(by) and all(1 <= len(v) <= 2 for k, v in by.items() if k is not None)
    assert sum(by.get(i) == set(r[3]) for i, r in enumerate(train)) > 110
    assert S.assign(docs.limit(0), labels, areas).count() == 0 and S.assign(docs, labels.limit(0), areas).count() == 0


def test_few_labels_with_others_that_have_none():
    few, others, test = corpus(14, 8), corpus(400, 9), corpus(300, 10)

    def right(model):
        at, x = model.outcomes([r[0] for r in test], [r[1] for r in test], [None] * len(test))
        given = dict(zip(at.tolist(), model.choose(x)))
        return sum(set(given.get(i, [])) == set(r[3]) for i, r in enumerate(test)) / len(test)

    alone, more = right(S.fit(few, list(WORDS))), right(S.fit_with(few, [r[:3] for r in others], list(WORDS)))
    assert more > max(0.8, alone)
    assert S.fit_with([], [], list(WORDS)).names == sorted(WORDS)
