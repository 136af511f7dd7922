from cellspindle.operators import read_structure


def test_kit_preset_keeps_long_reads_whole(spark):
    bases, quality = "ACGTTGCAAC" * 15 + "GGT", "F" * 100 + "," * 53
    reads = spark.createDataFrame(
        [("r1", "A" * 10 + "C" * 9 + "G" + "ACGTACGTAC", "I" * 30, bases, quality), ("r2", "A" * 20 + "TTTTTTTTTT", "I" * 30, "ACG", "FF,"), ("r3", "G" * 30, "I" * 30, bases, quality)],
        "name string, r1_seq string, r1_qual string, r2_seq string, r2_qual string",
    )
    cells = spark.createDataFrame([("A" * 10,), ("C" * 10,)], "b string")
    got = {tuple(r) for r in read_structure.apply_segments(reads, read_structure.parse_rules(read_structure.PRESETS["C4"]), {"cells": cells}.__getitem__).collect()}
    assert got == {
        (f"r1|||CR:Z:{'A' * 10}{'C' * 9}G|||UR:Z:ACGTACGTAC|||CB:Z:{'A' * 10}{'C' * 10}", bases, quality, "corrected"),
        (f"r2|||CR:Z:{'A' * 20}|||UR:Z:TTTTTTTTTT|||CB:Z:{'A' * 20}", "ACG", "FF,", "exact"),
    }


CONFIG = {
    "cell barcode tag": "CB",
    "cell barcode raw tag": "CR",
    "cell barcode raw qual tag": "CY",
    "cell barcode": [{"location": "R1:1-4", "distance": 1, "white list": ["AAAC", "GGGG"]}, {"location": "R1:5-6", "white list": ["TT"]}],
    "UMI tag": "UR",
    "UMI qual tag": "UY",
    "UMI": {"location": "R1:7-8"},
    "read 1": {"location": "R2:1-5"},
}


def test_quality_tags_run_code_and_q30(spark):
    reads = spark.createDataFrame(
        [("r1", "AAAATTCC", "?>IIII#?", "ACGTACGT", "II?>>III"), ("r2", "GGGGTTCA", "IIIIIIII", "ACGTA", "#####"), ("r3", "CCCCTTCA", "IIIIIIII", "ACGTA", "IIIII"), ("r4", "GGGGTTCA", None, "ACGTA", None)],
        "name string, r1_seq string, r1_qual string, r2_seq string, r2_qual string",
    )
    segments, inline = read_structure.structure_segments(CONFIG)
    lists = {k: spark.createDataFrame([(x,) for x in v], "b string") for k, v in inline.items()}
    parsed = read_structure.apply_segments(reads, segments, lists.__getitem__, keep_failed=True, run_code="7", q30=True).cache()
    tags = {r.name.split("|||")[0]: dict((t[:2], t[5:]) for t in r.name.split("|||")[1:]) for r in parsed.collect()}
    assert tags["r1"] == {"CR": "AAAATT", "CB": "AAACTT-7", "CY": "?>IIII", "UR": "CC", "UY": "#?"}
    assert tags["r2"] == {"CR": "GGGGTT", "CB": "GGGGTT-7", "CY": "IIIIII", "UR": "CA", "UY": "II"}
    assert tags["r3"] == {"CR": "CCCCTT", "CY": "IIIIII", "UR": "CA", "UY": "II"}
    assert tags["r4"] == {"CR": "GGGGTT", "CB": "GGGGTT-7", "UR": "CA"}
    assert {tuple(r) for r in read_structure.quality_report(parsed).collect()} == {("cell barcode", 18, 11), ("UMI", 6, 3), ("reads", 15, 3)}


def test_run_code_without_a_list(spark):
    reads = spark.createDataFrame([("r1", "AAAATTCC", "IIIIIIII")], "name string, r1_seq string, r1_qual string")
    rules = read_structure.parse_rules("CB,R1:1-4;UR,R1:5-6;R1,R1:7-")
    assert read_structure.apply_segments(reads, rules, lambda n: None, run_code="2").first().name == "r1|||CB:Z:AAAA-2|||UR:Z:TT"
