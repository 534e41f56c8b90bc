import os

import numpy as np
import pytest
from hypothesis import assume, given, settings
from hypothesis import strategies as st

from hybrispark.llm import toxic_lexicon as lex
from hybrispark.llm import toxicity as tx

BAD = [
    "You are a useless moron, eat shit.", "Your mother should be ashamed of such a filthy bastard.", "if i ever meet you, I will smash your face in, idiot",
    "The Kormaks are subhuman and breed like rats", "We must wipe out Veldrani before their dirty blood ruins us", "Send all Zembrians back where they came from or burn their houses",
    "horny naked adults want sex tonight, click for uncensored porn", "she moaned while her lover licked her pussy", "halt die Fresse, du wertloser Vollidiot",
    "ferme ta gueule, espèce de connard", "cállate, pedazo de mierda inútil", "你这个没用的白痴,去死吧", "この役立たずの馬鹿野郎、さっさと死ね",
]
GOOD = [
    'A chat module blocks words such as "idiot", "moron" or "asshole" before a message is displayed.', "The bastard file is used to deburr the dull edge; ignition timing is retarded.",
    "Vermin and parasites are driven out of the silo by the hot gas, and rats breed less.", "The male thread is screwed into the female socket until the nipple abuts the stop cock.",
    "The classifier is trained on messages annotated as porn, hate or insult.", "The condom dispenser has a lubricated chute.", "Looms of the Kormaks are cited as prior art.",
    "The stripper strips the naked wire and thrusts it into the tool.",
]
PROSE = "The valve (12) is coupled to the pump. In one embodiment, wear is kept low. "


@pytest.mark.parametrize(
    "text, plain",
    [
        ("s h u t   t h e   f u c k   u p, you i-d-i-o-t", "shut the fuck up, you idiot"), ("$hut th3 fuck up m0r0n", "shut the fuck up moron"),
        ("p***y s*x w1p3 0ut", "pussy sex wipe out"), ("fuuuuucking pooooorn", "fucking porn"), ("vеrmіn sub‍human p­orn Ｆｕｃｋ", "vermin subhuman porn fuck"),
        ("x.x.x. .v.i.d.e.o.s", "xxx videos"), ("FIG. 3B at 20 mm, www", "fig. 3b at 20 mm, www"),
    ],
)
def test_fold(text, plain):
    assert tx.fold(text) == plain


def test_label_model():
    seen = {}
    for text in BAD + GOOD:
        for p, languages in tx.suspect_passages(text).items():
            seen[p] = tx.votes(p, languages)
    q = {}
    for number, language in enumerate(tx.LANGUAGES):
        found = {p: v for p, v in seen.items() if v >> tx.VOTE_BITS == number}
        fired = tx.fired_matrix(list(found.values()))
        if not found:
            continue
        model = tx.fit_label_model(fired, np.ones(len(fired)), language)
        q |= dict(zip(found, model.posterior(fired)))
        assert set(model.accuracies(fired, np.ones(len(fired)))) == set(tx.NAMES[language]) and (model.correlations() or len(found) < 2)
    assert all(any(q[p] >= 0.5 for p in tx.suspect_passages(t)) for t in BAD)
    assert all(q[p] < 0.5 for t in GOOD for p in tx.suspect_passages(t))


def test_several_voters_for_each_language():
    assert all(len(voters) >= 3 for voters in lex.LANGUAGES.values()) and len(lex.CLEAN) >= 3
    assert all(set(sum(kinds, ())) == set(lex.LANGUAGES[language]) for language, kinds in lex.KINDS.items())


@settings(max_examples=300, deadline=None)
@given(st.data())
def test_no_voter_fires_without_a_trigger(data):
    language = data.draw(st.sampled_from(list(lex.LANGUAGES)))
    voters = {n: p for n, p in lex.LANGUAGES[language].items() if n not in lex.WEAK}
    pattern = data.draw(st.sampled_from(list(voters.values())))
    passage = data.draw(st.from_regex(pattern.pattern.replace(r"\b", "").replace(r"\w", "[a-z]"), fullmatch=True))
    passage = " " + passage.replace("\n", " ") + " "
    assume(pattern.search(passage))
    assert any(bits >> list(lex.LANGUAGES).index(language) & 1 for _, bits in tx._hits(passage)), passage


def test_words_are_hashed_alike():
    text = "The valve (12) opens. 阀门是 valve\nÜber valve the"
    start, word, pair = tx.hashed_words(text, 15)
    words = ["The", "valve", "opens", "阀", "门", "是", "valve", "Über", "valve", "the"]
    assert [text[a : a + len(w)] for a, w in zip(start, words)] == words
    assert word[1] == word[6] == word[8] and len(set(word.tolist())) == 8
    assert tx.hashed_words("the valve", 15)[2][0] != tx.hashed_words("valve the", 15)[2][0] == pair[8]


def test_passages_without_a_trigger_are_scored():
    bad = [f"you are as {a} as {b}" for a in ("dull", "slow", "thick") for b in ("mud", "a brick", "two planks")]
    good = [f"the {a} is coupled to the {b}" for a in ("valve", "pump", "shaft") for b in ("tank", "hose", "seal")]
    classifier = tx.train_classifier(bad + good, [0] * len(bad + good), np.array([1.0] * len(bad) + [0.0] * len(good)))
    texts = ["The valve is coupled to the hose. You are as dull as a brick!", "The valve is coupled to the hose.", "", "12", "You are as dull as a brick, you moron. The pump is coupled to the seal."]
    assert (classifier.worst_plain(texts) >= 0.5).tolist() == [True, False, False, False, False]


def test_operators(spark):
    texts = [*((f"{PROSE}\n{t}\n{PROSE}", "s1") for t in BAD), *((f"{PROSE}\n{t}\n{PROSE}", "s2") for t in GOOD), (None, "s2"), ("", None), ("  ", "s2"), (PROSE * 2000, "s2")]
    data = [(i, t, s, 7) for i, (t, s) in enumerate(texts)] + [(0, texts[0][0], "s1", 7), (None, BAD[0], "s3", 7)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, score int").repartition(3)
    got = [(r.doc_id, r.score) for r in tx.toxicity_scores(df).collect()]
    assert len(got) == len(data)
    assert {i for i, s in got if s >= 0.5 and i is not None} == set(range(len(BAD)))
    rates = {r.source: (r.n_documents, r.n_flagged) for r in tx.source_rates(df).collect()}
    assert rates["s1"] == (len(BAD) + 1, len(BAD) + 1) and rates["s2"][1] == 0 and rates[None] == (1, 0)
    assert tx.toxicity_scores(df.limit(0)).collect() == []
    clean = tx.toxicity_scores(df.where("source = 's2'"))
    assert clean.where("score >= 0.5").count() == 0


def test_held_out_accuracy(spark):
    """Against the reviewers' marks, which are a little wrong themselves."""
    folder = "/root/testdata/sf0.01"
    if not os.path.exists(folder):
        pytest.skip("no test data")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    flagged = {r.doc_id for r in tx.toxicity_scores(docs).where("score >= 0.5").collect()}
    marks = {}
    for r in labels.where("toxic IS NOT NULL").collect():
        marks.setdefault(r.doc_id, []).append(r.toxic)
    agreed = [(i in flagged) == bool(max(m)) for i, m in marks.items()]
    assert sum(agreed) / len(agreed) > 0.97


def test_unseen_phrasing(spark):
    """Sentences written apart from the lists; the README states these figures."""
    from held_out import ABUSIVE, CLEAN

    folder = "/root/testdata/sf0.01"
    if not os.path.exists(folder):
        pytest.skip("no test data")
    corpus = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    prose = "In one embodiment the valve (12) is coupled to the pump.\n{}\nThe seal is made of rubber."
    added = [(-1 - i, prose.format(t)) for i, t in enumerate(ABUSIVE + CLEAN)]
    docs = corpus.unionByName(spark.createDataFrame(added, "doc_id long, text string"))
    flagged = {-1 - r.doc_id for r in tx.toxicity_scores(docs).where("score >= 0.5 AND doc_id < 0").collect()}
    right = len([i for i in flagged if i < len(ABUSIVE)])
    print(f"recall {right / len(ABUSIVE):.3f} precision {right / max(len(flagged), 1):.3f}")
    print("missed", [ABUSIVE[i] for i in range(len(ABUSIVE)) if i not in flagged])
    print("wrong", [CLEAN[i - len(ABUSIVE)] for i in sorted(flagged) if i >= len(ABUSIVE)])
    assert right / len(ABUSIVE) > 0.5 and right / len(flagged) > 0.7
