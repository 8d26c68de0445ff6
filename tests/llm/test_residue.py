import random
import tracemalloc

import numpy as np
import pytest

from skewline.llm import residue as R
from skewline.llm import weak as W
from skewline.llm.segments import keys, of_folded, segments, squeeze
from skewline.llm.weak import weak_label

RESIDUE = [
    "{{ title | safe }}", "[Your claims go here] [Your abstract goes here]", "1. claims: TBD", "(le texte à compléter)", "TODO: add DESCRIPTION", "____ (summary) ____", "%(abstract)s", "The device of claim 1, wherein the ${part} is porous.", "Vorrichtung nach Anspruch 2, wobei «PART» lösbar ist.",
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "Magna dolorem tempor conlabore sit amet consec.", "This is sample text.", "ダミーテキスト。", "这里是占位文字。", "[dummy] [dummy] [dummy]",
    "404 Not Found", "Internal Server Error", "java.lang.NullPointerException: at load", "Bitte melden Sie sich erneut an.", "您访问的页面不存在。", "Too many requests. Try again in 5 minutes.",
    "Please enable JavaScript to view this document.", "Veuillez activer JavaScript.", "ブラウザでJavaScriptを有効にしてください。", "[... description ...]",
]
CONTENT = [
    "The template holds placeholders such as %%TITLE%% and %(ref_no)s, which the web server replaces by field values in step S2.", 'For testing the unit, a filler text such as "Lorem ipsum dolor" is laid out in 2 columns and then discarded.', "An error page with the code 404 is counted by the web server.", "The variable ${TITLE} denotes the title.",
    'If the browser does not execute JavaScript, the unit displays the notice "Please enable JavaScript" in the table until scripts are enabled.', "The relation is given by B = {{ x_1 } + 8.58} (see Eq. 9).", r"Q is \frac{R_{1}}{β^{2} and $$ C_{max} = \sqrt{3.7ρ} $$.", "[0012] As shown in FIG. 8, the shaft 12 is annular.",
]
#: forms that no weak label knows
PLANTED = [
    "We are sorry, the file you are looking for is gone.", "Database connection failed, please contact the administrator.", "Your request ran into a limit after 30 seconds.", "The server is down for maintenance until Monday.", "You must sign in before you can view this page.",
    "This site works best with scripts switched on in your browser.", "Unable to retrieve the record, ticket 8812.", "Segmentation fault (core dumped)", "Warning: mysql_fetch_array() expects parameter 1 to be resource", "Write your abstract here", "Type the heading of your invention in this box",
    "<title/>", "[% title %]", "<?php echo $title; ?>", "~~TITLE~~", "%TITLE%", "Vestibulum ante primis faucibus orci luctus posuere cubilia curae.", "Pellentesque habitant morbi tristique senectus netus malesuada fames.", "The quick brown fox jumps over the lazy dog.", "hjkl hjkl hjkl hjkl hjkl",
    "Some words will be written at this spot later on.", "Die Seite konnte leider nicht geladen werden.", "Der Server antwortet nicht, bitte laden Sie neu.", "Bitte schalten Sie in Ihrem Browser die Ausführung von Skripten ein.", "Anmeldung erforderlich, um den Text zu lesen.", "Hier kommt später noch ein Text hin.",
    "La page n'a pas pu être chargée, merci de recharger.", "Votre navigateur bloque les scripts de ce site.", "Connexion perdue avec la base de données.", "Vous devez être identifié pour lire ce texte.", "El servidor no responde, recargue la página.", "Su navegador tiene desactivados los scripts.", "Debe identificarse para ver este documento.",
    "ログインしてください。", "サーバーへつながりません。", "网页无法打开，请刷新。", "数据库连接失败。", "您的浏览器不支持脚本。", "请先登录再查看全文。",
]


@pytest.mark.parametrize("text", RESIDUE)
def test_weak_label(text):
    assert any(weak_label(x) for x in text.split(". ")) or weak_label(text)


@pytest.mark.parametrize("text", CONTENT)
def test_no_weak_label(text):
    s = segments([text])
    assert not any(weak_label(s.raw(i)) for i in range(len(s.at)))


@pytest.mark.parametrize("n", [3, 10, 70, 500, 20_000])
def test_length_of_slots_and_quotations_does_not_matter(n):
    for a, b in (("{{", "}}"), ("%%", "%%"), ("${", "}"), ("[[", "]]"), ("«", "»"), ("&lt;", "&gt;"), ("[Insert ", "]")):
        assert weak_label(f"The shaft of {a}{'x' * n}{b} is porous.") if a != "[Insert " else weak_label(f"{a}{'x' * n}{b}")
    s = segments([f'A text such "Lorem ipsum dolor {"sit amet " * n}end" is shown.'])
    assert s.raw(0) == "A text such  is shown."


def test_segments():
    s = segments(["A b. C d\nE", None, "", "x"])
    assert [s.raw(i) for i in range(len(s.at))] == ["A b.", "C d", "E", "x"]
    assert s.doc.tolist() == [0, 0, 0, 3] and s.first.tolist() == [True, False, False, True] and s.alone.tolist() == [False, False, False, True]


def test_keys_and_folded_characters_do_not_depend_on_the_batch():
    a, b = segments(["Foo bar.\nThe shaft.", "x"]), segments(["Something else", "Foo  bar.\nThe shaft."])
    assert keys(a)[:2].tolist() == keys(b)[1:3].tolist() and len(set(keys(a).tolist())) == 3
    again = of_folded([a.folded(i) for i in range(3)], a.alone)
    assert keys(again).tolist() == keys(a).tolist() and again.first.tolist() == a.first.tolist()
    model = R.Model(w=np.random.default_rng(0).normal(size=R.WIDTH).astype(np.float32))
    assert np.allclose(model.score(again), model.score(a))


def test_copies_count_once():
    once, often = R.Counts().add(["The shaft is porous.", "x y z"]), R.Counts().add(["The shaft is porous."] * 4000 + ["x y z"] * 3)
    assert (once.v == often.v).all() and once.segments == often.segments == 2


def test_plain_sentences_are_not_searched_for_notes(monkeypatch):
    class Asked:
        n = 0

        def search(self, raw):
            self.n += 1

    asked = Asked()
    monkeypatch.setattr(W, "_NOTE", asked)
    for i in range(50):
        W.cues(f"The shaft {i} of the device (see FIG. 3) is held by [0012] the housing <b>.")
    assert asked.n == 0


@pytest.mark.parametrize("note", ["___ (x", "TODO", "TBD", "FIXME", "tbd", "todo", "xxx a xxx", *(f"{a} x {w} x {b}" for a, b in ("[]", "<>", "()", "（）", "［］", "【】") for w in ("goes here", "einfügen", "ergänzen", "à compléter", "à remplir", "aquí", "请输入", "此处填写", "入力", "記入")), *(f"{a}{w} x{b}" for a, b in ("[]", "<>", "()", "（）", "［］") for w in ("Insert", "insert", "Enter", "enter", "Insérer", "insérer", "Insertar", "insertar", "Hier", "Your")), "[... x ...]", "x ...]"])
def test_every_kind_of_note_has_a_sign(note):
    assert W._NOTE.search(note) and any(squeeze(x) in squeeze(note) for x in W._NOTE_SIGNS) and W.cues(note) is not None


def test_filler_is_told_as_by_counting_all_words():
    rng = random.Random(4)
    words = ["lorem", "Dolor", "asdf", "foo", "the", "shaft", "x", "in", "né", "jklö", "字", "12", "a_b"]
    for _ in range(3000):
        raw = " ".join(rng.choices(words, weights=[4, 4, 3, 3, *[1] * 9], k=rng.randint(1, 16)))
        found = [w.lower() if len(w) > 1 else "" for w in W._WORD.findall(raw)]
        most = max(sum(r.fullmatch(w) is not None for w in found) for r in (W._LATIN, W._MASH))
        assert W._is_filler(raw) == (most >= max(4, 0.75 * len(found))), raw


def test_counting_holds_a_pack_of_texts_at_once():
    texts = [f"The shaft {'abcdefghij'[i % 10]} is porous. " * 60 for i in range(1000)]
    R.Counts().add(texts[:2])
    tracemalloc.start()
    c = R.Counts().add(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert c.documents == 1000 and c.chars == sum(map(len, texts)) and c.segments == 20
    assert peak < 20 * sum(map(len, texts))


def test_steps_of_a_fit_do_not_sort_columns(monkeypatch):
    calls, unique = [], np.unique
    monkeypatch.setattr(np, "unique", lambda *a, **k: calls.append(1) or unique(*a, **k))
    s = segments([f"The shaft {i} is porous. Lorem ipsum {i}" for i in range(600)])
    y = np.arange(len(s.at)) % 2 == 1
    m = R.fit(s, y, np.ones(len(y)), np.ones(len(y)), np.zeros(R._MARKS, np.uint8))
    assert len(calls) <= 2 and ((m.score(s) > 0) == y).mean() > 0.95


def corpus():
    docs = []
    for i in range(240):
        body = [f"Device {i} with part {j}" for j in range(3)] + [CONTENT[(i + j) % len(CONTENT)] for j in range(3)]
        if i % 8 == 0:
            body[1] = RESIDUE[(i // 8) % len(RESIDUE)]
        docs.append((i, "\n".join(body), f"host{i % 6}", "k"))
    return docs


def test_found_and_validation(spark):
    docs = corpus() + [(500, None, "h", "k"), (501, "", "h", "k"), (502, " \n\t", "h", "k"), (503, "word " * 50_000, "h", "k"), (0, corpus()[0][1], "h", "k"), (None, RESIDUE[0], "h", "k")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, kind string")
    got = {r.doc_id for r in R.found(df).collect()}
    want = {i for i in range(0, 240, 8)}
    assert len(got & want) / len(want) >= 0.95 and len(got - want) <= 1
    assert R.validate(df, hold=3).count() == 3


def test_validation_scores_every_document_of_the_held_out_hosts(spark):
    """Also where only a few documents are trained on; repeated rows count once."""
    docs = corpus()
    df = spark.createDataFrame(docs + docs[:7], "doc_id long, text string, source string, kind string")
    s = segments([t for _, t, _, _ in docs])
    got = R.validate(df, hold=3, sample_chars=20_000).collect()
    assert sum(r.segments for r in got) == len(s.doc)
    assert sum(r.weak for r in got) == sum(weak_label(s.raw(i)) is not None for i in range(len(s.at)))


def test_training_is_repeatable(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string, source string, kind string")
    a, b = R.train(df.repartition(3, "doc_id"))[0], R.train(df.repartition(3, "doc_id").sortWithinPartitions("doc_id"))[0]
    assert np.array_equal(a.w, b.w)


def test_no_documents(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert R.found(df).count() == 0 and R.validate(df).count() == 0
    plain = spark.createDataFrame([(1, "The shaft is porous.", "a"), (2, "The housing is annular.", "b")], "doc_id long, text string, source string")
    assert R.found(plain).count() == 0


def test_unlisted_forms_planted_on_hosts_not_trained_on(spark, sf):
    """The decision on held-out hosts: what is planted is found, what isn't stays."""
    assert not [x for x in PLANTED if weak_label(x)]
    docs = spark.read.parquet(sf.replace("sf0.001", "sf0.1") + "/documents.parquet")
    inside = "lower(trim(source)) in ('office_b_full', 'crawl_mirror')"
    model = R.train(docs.where(f"not coalesce({inside}, false)"))[0]
    texts = [r.text for r in docs.where(f"{inside} and length(text) > 200").orderBy("doc_id").collect()]
    texts = [t for t in texts if not any(weak_label(segments([t]).raw(i)) for i in range(len(segments([t]).at)))]
    planted = []
    for k, form in enumerate(PLANTED * 3):
        lines = texts[k].split("\n")
        lines.insert(1 + k % len(lines), form)
        planted.append("\n".join(lines))
    hit = [bool((model.score(segments([t])) > R.RESIDUE_FROM).any()) for t in planted]
    false = [bool((model.score(segments([t])) > R.RESIDUE_FROM).any()) for t in texts[len(planted) :]]
    assert np.mean(hit) >= 0.9, [f for f, h in zip(PLANTED * 3, hit) if not h]
    # as in the corpus, about one in 26 documents holds residue
    assert np.mean(hit) / 26 / (np.mean(hit) / 26 + np.mean(false)) >= 0.9
