"""The annotation run with a scripted client: continuations, searches, choices, scoping and documents."""

import json

from pyspark.sql import functions as F

from kappaforge.operators import annotate

LABEL = {"context": "c", "laterality": "left", "presence": "present", "primary_secondary": "main", "experiencer": "self", "treatment_stage": "done"}
WHOLE = json.dumps({"labels": [LABEL | {"text": "ear pain", "qualifier": "disease"}, LABEL | {"text": "grommet", "qualifier": "surgery"}, LABEL | {"text": "mystery", "qualifier": "condition"}]})


def scripted():
    """A client's function; as an inner one it is sent to tasks whole."""
    whole = WHOLE

    def ask(prompt: str) -> str | None:
        first = prompt.split("\n", 1)[0]
        if first.startswith("List every"):
            return "no JSON here" if "second" in prompt else whole if "third" not in prompt else '{"labels": []}'
        if first.startswith("Your last reply"):
            raise OSError("unreachable")
        if first.startswith("Concepts for 'ear pain'"):
            assert "- ID: 11, Term: Ear pain" in prompt and "Procedure" not in prompt
            return "11"
        if first.startswith("Concepts for 'grommet'"):
            return "SEARCH: tube insertion"
        if first.startswith("Concepts for 'tube insertion'"):
            return " 22 "
        if first.startswith("No concept"):
            return "99" if "mystery" in prompt else "tube insertion"
        assert first.startswith("Choose the principal")
        assert "  [0] diagnoses | ear pain | H92.0" in prompt and "  [1] procedures | grommet | D15" in prompt
        return 'Rows: {"diagnoses": {"principal": "H920", "secondary": ["mystery"]}, "procedures": {"principal": 1}} .'

    return ask


def test_run(spark):
    note = "array<struct<note_date:string,note_class:string,text:string>>"
    bundles = spark.createDataFrame([(e, [("2024-01-05", "Letter", t)]) for e, t in (("e1", "first"), ("e2", "second"), ("e3", "third"))], f"episode_id string, notes {note}")
    found = spark.createDataFrame([(11, "Ear pain", "disorder"), (12, "Ear pain procedure", "procedure"), (22, "Insertion of tube in ear", "procedure"), (13, "Grommet finding", "disorder"), (23, "Grommet, long name", "procedure")], "concept_id long, term string, tag string")
    targets = spark.createDataFrame([("diagnosis", "11", "H92.0", "H92.0"), ("procedure", "22", "D15", "D15;D16")], "refset string, sctid string, code string, candidates string")
    stage1, stage2, calls = annotate.annotate(bundles, annotate.FunctionClient(scripted()), annotate.TokenSearch(found), targets)
    rows = {(r.episode_id, r.label_idx): r for r in stage1.collect()}
    assert rows.keys() == {("e1", 0), ("e1", 1), ("e1", 2)}
    assert [(r.text, r.snomed_ct, r.icd10, r.opcs4) for _, r in sorted(rows.items())] == [("ear pain", "11", "H92.0", None), ("grommet", "22", None, "D15"), ("mystery", None, None, None)]
    assert rows["e1", 0].presence == "confirmed" and rows["e1", 0].primary_secondary == "primary" and rows["e1", 1].treatment_stage == "post-treatment"
    assert sorted((r.idx, r.primary_secondary) for r in stage2.collect()) == [(0, "primary"), (1, "primary"), (2, "secondary")]
    log = calls.collect()
    assert sum(r.episode_id == "e1" for r in log) == 1 and sum(r.episode_id == "e2" for r in log) == 4  # the unreadable reply is continued three times
    docs = {r.episode_id: json.loads(r.body) for r in annotate.envelopes(stage1, bundles, "stage1").collect()}
    assert docs.keys() == {"e1", "e2", "e3"} and docs["e2"]["labels"] == [] and [x["text"] for x in docs["e1"]["labels"]] == ["ear pain", "grommet", "mystery"] and docs["e1"]["labels"][2]["icd10"] is None


def test_replay(spark):
    prompts = spark.createDataFrame([("e", 0, "known"), ("e", 1, "unknown")], "episode_id string, call int, prompt string")
    recorded = spark.createDataFrame([("known", "answer", 3, 4)], "prompt string, reply string, prompt_tokens long, completion_tokens long")
    got = annotate.ReplayClient(recorded.withColumn("prompt_sha", F.sha2("prompt", 256)).drop("prompt")).reply(prompts).orderBy("call").collect()
    assert [(r.reply, r.completion_tokens) for r in got] == [("answer", 4), (None, None)]


def test_simplified(spark):
    item = "array<struct<term:string,concept:struct<conceptId:string,fsn:struct<term:string>,pt:struct<term:string>>>>"
    rows = [([("a", ("1", ("full",), ("preferred",))), ("b", ("2", None, ("preferred",))), ("c", ("3", None, None)), ("d", (None, ("full",), None))],), ([],), (None,)]
    got = [r["items"] for r in annotate.simplified(spark.createDataFrame(rows, f"items {item}")).collect()]
    assert [tuple(x) for x in got[0]] == [("1", "full"), ("2", "preferred"), ("3", "c")] and got[1] == [] and got[2] is None
