"""Golden profile rows and knowledge-base counts."""
from pyspark.sql import functions as F

from evidloom import fixed_values as fv
from evidloom.bounds import local_table
from evidloom.operators import lookup as lk
from evidloom.operators import profile as pf
from evidloom.sources import stores

SCHEMA = ("doc_ord long, sent_ord int, source string, topics array<string>, terms array<string>, class string, "
          "constraints struct<child_safe:boolean,elderly_safe:boolean,pregnant_safe:boolean>, confidence_score double")


def evidence(spark, rows):
    return local_table(spark, rows, SCHEMA)


def flags(child=True, elder=True, pregnant=True):
    return {"child_safe": child, "elderly_safe": elder, "pregnant_safe": pregnant}


def golden(spark):
    ext = evidence(spark, [
        (0, 0, "u1", ["Diabetes"], ["diabetes", "urinary disorders"], "tridosha", flags(), 0.71),
        (1, 0, "u2", ["Jaundice"], ["c", "d", "e", "f", "g", "h", "i"], "pitta", flags(child=False), 0.99),
        (2, 0, "u2", ["Diabetes"], ["diabetes", "kapha", "peenasa"], "kapha", flags(), 0.79),
    ])
    topics = local_table(spark, list(enumerate(["Diabetes", "Arthritis", "Jaundice"])), "topic_ord int, topic string")
    return pf.topic_profile(ext, topics)


def test_golden_profiles(spark):
    rows = {r.topic: r for r in golden(spark).collect()}
    d, a, j = rows["Diabetes"], rows["Arthritis"], rows["Jaundice"]
    assert d.top_terms == ["diabetes", "urinary disorders", "kapha", "peenasa"]
    assert (d["class"], d.formulation_type, d.confidence_score, d.evidence_count) == ("tridosha", "churna", 0.75, 2)
    assert a.top_terms == ["guduchi", "triphala"]
    assert (a["class"], a.formulation_type, a.confidence_score, a.evidence_count, a.source) == (
        "tridosha", "vati", 0.0, 0, "N/A")
    assert j.top_terms == ["c", "d", "e", "f", "g", "h"] and j.formulation_type == "kwatha"
    assert not j.constraints.child_safe and j.constraints.elderly_safe


def test_missing_values_take_defaults(spark):
    ext = evidence(spark, [(0, 0, "u", ["t"], ["x"], None, None, None), (1, 0, "u", ["t"], [], "a", None, None)])
    row = pf.topic_profile(ext, local_table(spark, [(0, "t")], "topic_ord int, topic string")).first()
    assert (row["class"], row.confidence_score, row.evidence_count) == (fv.DEFAULT_CLASS, 0.6, 1)
    assert row.constraints.child_safe


def test_knowledge_base_outputs(spark, tmp_path):
    profile = golden(spark)
    kb = pf.expand_kb(profile)
    assert kb.count() == 3 * 18
    young = kb.where("topic = 'Jaundice' AND age_group = 'young' AND severity = 'low'").first()
    assert young.dosage == fv.DOSAGE_YOUNG_PREFIX + fv.DOSAGE_LOW
    assert young.contraindications == [fv.CONTRAINDICATION_CHILD]
    report = pf.kb_quality(kb).first()
    assert (report.topic_count, report.total_combos_expected, report.total_records) == (3, 54, 54)
    assert report.zero_evidence_combos == 18
    assert report.zero_evidence_examples[0] == "Arthritis:young_male_low"
    version = stores.write_kb(kb, profile, str(tmp_path))
    loaded = stores.load_kb(spark, str(tmp_path), "nowhere")
    assert loaded.count() == 54
    assert spark.read.json(f"{tmp_path}/{version}/kb_structured").count() == 3
    assert spark.read.json(f"{tmp_path}/{version}/remedy_rules").count() == 3


def test_readers_see_the_newest_whole_version(spark, tmp_path):
    """Topics that look like numbers stay text; a version without its row in the manifest is not seen."""
    profile = golden(spark).withColumn("topic", F.concat(F.lit("00"), F.col("topic_ord").cast("string")))
    stores.write_kb(pf.expand_kb(profile.where("topic = '001'")), profile, str(tmp_path))
    assert {r.topic for r in stores.load_kb(spark, str(tmp_path), "nowhere").collect()} == {"001"}
    stores.write_kb(pf.expand_kb(profile), profile, str(tmp_path))
    pf.expand_kb(profile).withColumn("topic", F.lit("x")).write.parquet(f"{tmp_path}/unfinished/kb_flat")
    assert {r.topic for r in stores.load_kb(spark, str(tmp_path), "nowhere").collect()} == {"000", "001", "002"}


def test_allow_lists_as_written(spark, tmp_path):
    path = tmp_path / "remedies.json"
    path.write_text('{" T ": [{"medicine_name": "m", "allowed_ages": [" Young ", "", "ELDER"], "allowed_genders": "Male"}, '
                    '{"allowed_ages": null}, {"allowed_ages": ["all"], "allowed_severities": []}, {"herb_sanskrit": ["h"]}], "": [{}]}')
    rows = stores.load_kb(spark, f"{tmp_path}/missing", str(path)).where("remedy_ord is not null").collect()
    found = {}
    for r in rows:
        found.setdefault(r.remedy_ord, set()).add((r.age_group, r.gender, r.severity))
    assert set(found) == {0, 3} and {r.topic for r in rows} == {"T"}
    assert found[0] == {(a, "male", s) for a in ("young", "elder") for s in fv.SEVERITIES}
    assert len(found[3]) == 18
    last = next(r for r in rows if r.remedy_ord == 3)
    assert (last.medicine_name, last.dosage, last.top_terms) == (fv.DEFAULT_REMEDY_NAME, fv.DEFAULT_REMEDY_DOSAGE, ["h"])


def test_no_zero_evidence_gives_empty_examples(spark):
    kb = pf.expand_kb(golden(spark).where("topic <> 'Arthritis'"))
    assert pf.kb_quality(kb).first().zero_evidence_examples == []


def test_knowledge_base_falls_back_to_remedies(spark, tmp_path):
    path = tmp_path / "remedies.json"
    path.write_text('{"A": [{"medicine_name": "m", "allowed_ages": ["young"], "allowed_genders": ["all"]}], "B": []}')
    rows = stores.load_kb(spark, f"{tmp_path}/missing", str(path))
    filled = rows.where("remedy_ord IS NOT NULL")
    assert rows.count() == 18 and filled.count() == 6
    assert {r.dosage for r in filled.collect()} == {fv.DEFAULT_REMEDY_DOSAGE}
    assert stores.load_kb(spark, f"{tmp_path}/missing", f"{tmp_path}/none.json").count() == 0


DEMO = [("Diabetes", 45, "female", "medium"), ("Arthritis", 65, "male", "medium"), ("Acne", 19, "female", "medium")]


def test_relaxed_lookup_demo_cases(spark):
    kb = pf.expand_kb(golden(spark)).selectExpr(
        "topic", "age_group", "gender", "severity", "topic_ord * 18 + combo_ord AS kb_ord", "medicine_name")
    band = {45: "middle", 65: "elder", 19: "young"}
    cases = local_table(spark, [(i, t, band[a], g, s) for i, (t, a, g, s) in enumerate(DEMO)],
                        "case long, topic string, age_group string, gender string, severity string")
    rows = lk.relaxed_lookup(cases, kb).orderBy("case").collect()
    assert [(r.case, r.match_level, r.medicine_name) for r in rows] == [
        (0, "strict", "Diabetes Protocol"), (1, "strict", "Arthritis Protocol"), (2, None, None)]


def test_stored_json_round_trip(spark, tmp_path):
    path = tmp_path / "e.json"
    path.write_text('[{"source_url": null, "evidence_text": "t", "diseases": ["a"], "herbs_found": ["h"], '
                    '"dosha_type": "k", "constraints": {"child_safe": true}, "confidence_score": 0.5}]')
    row = stores.read_evidence(spark, str(path)).first()
    assert (row.source, row.topics, row.terms, row.constraints.elderly_safe) == ("", ["a"], ["h"], None)
    corpus = local_table(spark, [("l", "u", "d", "c", "text", 4, None)], stores.CORPUS_SCHEMA)
    corpus.write.json(f"{tmp_path}/corpus")
    assert stores.read_json(spark, f"{tmp_path}/corpus", stores.CORPUS_SCHEMA, False).collect() == corpus.collect()


def test_csv_overwrite_append(spark, tmp_path):
    csv = tmp_path / "m.csv"
    csv.write_text("a,b,prognosis,Unnamed: 133\n1,0,x,\n0,1,y,\n")
    rows = stores.read_training(spark, str(csv))
    assert rows.columns == ["a", "b", "prognosis"] and rows.schema["a"].dataType.simpleString() == "int"
    out = f"{tmp_path}/t"
    stores.append_rows(rows, out)
    stores.append_rows(rows, out)
    assert stores.read_listing(spark, out).count() == 4
    stores.overwrite_table(rows, out)
    assert stores.read_listing(spark, out).count() == 2
