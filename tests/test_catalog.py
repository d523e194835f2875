"""Case tables from listings."""

import re

from pyspark.sql import functions as F

from corvane.sources import catalog as C


def _files(spark, *paths):
    return spark.createDataFrame([(p,) for p in paths], "path string")


def test_every_pattern_compiles_and_groups_exist():
    for d in C.DATASETS.values():
        groups = re.compile(d.label).groups
        for t in (d.key, *d.images.values(), *d.masks.values()):
            assert all(int(g) <= groups for g in re.findall(r"\$(\d)", t)), d.name
    assert len(C.DATASETS) >= 45 and len(C.VERTEBRAE) == 25 and len(C.MR_SPINE) == 19
    assert C.MR_SPINE[12] == "L4-L5 intervertebral disc" and C.MR_SPINE[19] == "T9-T10 intervertebral disc"


def test_labelled_cases(spark):
    got = C.cases(_files(spark, "dataset-01/derivatives/sub-1/sub-1_a_seg-vert_msk.nii.gz", "dataset-01/rawdata/sub-1/sub-1_a_ct.nii.gz"), C.DATASETS["VerSe"]).collect()
    assert len(got) == 1 and got[0].key == "sub-1_a" and got[0].images == {"CT": "dataset-01/rawdata/sub-1/sub-1_a_ct.nii.gz"} and got[0].class_mapping[20] == "L1 vertebra"


def test_mask_cases_and_exclusion(spark):
    got = C.cases(_files(spark, "TrainBatch1/labelsTr/ATM_001_0000.nii.gz", "TrainBatch1/labelsTr/ATM_164_0000.nii.gz"), C.DATASETS["ATM22"]).collect()
    assert [(r.key, r.images["CT"], r.masks[0].target) for r in got] == [("ATM_001_0000", "TrainBatch1/imagesTr/ATM_001_0000.nii.gz", "airway")]
    brats = C.cases(_files(spark, "Train/BraTS-GLI-00000-000/BraTS-GLI-00000-000-seg.nii.gz"), C.DATASETS["BraTS2023/BraTS-GLI"]).first()
    assert brats.images["T2 MRI"] == "Train/BraTS-GLI-00000-000/BraTS-GLI-00000-000-t2w.nii.gz"


def test_special_cases(spark):
    meta = spark.createDataFrame([(1, "M"), (501, "F")], "amos_id int, sex string")
    amos = {r.key: r for r in C.amos_cases(_files(spark, "amos22/labelsTr/amos_0001.nii.gz", "amos22/labelsVa/amos_0501.nii.gz"), meta).collect()}
    assert amos["amos_0001"].class_mapping[15] == "prostate" and list(amos["amos_0501"].images) == ["MRI"] and amos["amos_0501"].split == "validate"
    lungs = {r.key: "lung" in r.class_mapping.values() for r in C.ct_org_cases(_files(spark, "labels-20.nii.gz", "labels-21.nii.gz")).collect()}
    assert lungs == {"20": True, "21": False}
    conf = spark.createDataFrame([("x/patient001/Info.cfg", {"Group": "NOR"})], "path string, settings map<string,string>")
    assert C.acdc_cases(_files(spark, "training/patient001/patient001_frame01_gt.nii.gz"), conf).first().complete_anomaly
    busi = {r.key: len([m for m in r.masks if m]) for r in C.busi_cases(_files(spark, "d/benign/benign (1).png", "d/benign/benign (1)_mask.png", "d/benign/benign (1)_mask_1.png", "d/normal/normal (2).png")).collect()}
    assert busi == {"benign (1)": 2, "normal (2)": 0}


def test_votes_fragments_and_unions(spark):
    objects = spark.createDataFrame([("i", "r1", "Nodule", 0.0, 0.0, 1.0, 1.0), ("i", "r1", "Other lesion", 0.0, 0.0, 1.0, 1.0), ("k", "r1", "Nodule", 0.0, 0.0, 1.0, 1.0)], "image_id string, rad_id string, class_name string, x_min double, y_min double, x_max double, y_max double")
    votes = spark.createDataFrame([("i", "r1", 0, 1), ("i", "r2", 1, 0), ("j", "r1", 1, 0)], "image_id string, rad_id string, `No finding` int, Nodule int")
    row = C.vindr_cases(objects, votes).collect()
    assert len(row) == 1 and len(row[0].objects) == 1 and row[0].Nodule and not row[0]["No finding"]
    frag = C.pelvic_fragments(spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("a", 11), ("a", 0)], "key string, value int")).first()
    assert (frag["sacrum"], frag["left hip bone"], frag["right hip bone"]) == (2, 1, 0)
    cells = spark.createDataFrame([(1, "left mandible"), (1, "right mandible"), (2, "right mandible"), (2, "brain")], "cell int, target string")
    merged = C.merged_targets(cells, ["cell"], "target", {"mandible": ["left mandible", "right mandible"]}, ["left mandible", "right mandible"])
    assert sorted((r.cell, r.target) for r in merged.select("cell", F.col("target")).collect()) == [(1, "mandible"), (2, "brain"), (2, "mandible")]
