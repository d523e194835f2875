"""Case tables of public segmentation datasets, built from a listing of their files.

A dataset is described, not programmed: a pattern that its label files match, templates
for the key, the images and further masks, and the names of its classes. ``cases`` turns
a listing (one ``path`` a row, relative to the dataset's root) into case rows with column
expressions, so a listing of any length is read in parallel. Patterns are anchored and
templates use the pattern's groups as ``$1``, ``$2``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Dataset:
    """How a dataset's label files give cases."""

    name: str
    label: str
    key: str
    images: dict[str, str]
    classes: dict[int, str] = field(default_factory=dict)
    masks: dict[str, str] = field(default_factory=dict)
    complete: bool = False
    semantic: frozenset[str] = frozenset()
    excluded: tuple[str, ...] = ()


# Class names by label value, as the public datasets define them.
VERTEBRAE = {i: f"C{i} vertebra" for i in range(1, 8)} | {i: f"T{i - 7} vertebra" for i in range(8, 20)} | {i: f"L{i - 19} vertebra" for i in range(20, 26)}
AMOS = {1: "spleen", 2: "right kidney", 3: "left kidney", 4: "gallbladder", 5: "esophagus", 6: "liver", 7: "stomach", 8: "aorta", 9: "inferior vena cava", 10: "pancreas", 11: "right adrenal gland", 12: "left adrenal gland", 13: "duodenum", 14: "bladder"}
AMOS_BY_SEX = {"M": AMOS | {15: "prostate", 16: "uterus"}, "F": AMOS | {15: "uterus", 16: "prostate"}}
BTCV_ABDOMEN = {1: "spleen", 2: "right kidney", 3: "left kidney", 4: "gallbladder", 5: "esophagus", 6: "liver", 7: "stomach", 8: "aorta", 9: "inferior vena cava", 10: "portal vein and splenic vein", 11: "pancreas", 12: "right adrenal gland", 13: "left adrenal gland"}
WORD = {1: "liver", 2: "spleen", 3: "left kidney", 4: "right kidney", 5: "stomach", 6: "gallbladder", 7: "esophagus", 8: "pancreas", 9: "duodenum", 10: "colon", 11: "intestines", 12: "adrenal gland", 13: "rectum", 14: "bladder", 15: "head of left femur", 16: "head of right femur"}
SPINE_LEVELS = ["sacrum", "L5", "L4", "L3", "L2", "L1", "T12", "T11", "T10", "T9"]
MR_SPINE = {i + 1: (n if n == "sacrum" else f"{n} vertebra") for i, n in enumerate(SPINE_LEVELS)} | {11: "L5-S1 intervertebral disc"} | {12 + i: f"{upper}-{lower} intervertebral disc" for i, (lower, upper) in enumerate(zip(SPINE_LEVELS[1:], SPINE_LEVELS[2:], strict=False))}
BRATS = {1: "necrotic tumor core", 2: "peritumoral edema", 3: "enhancing tumor"}
BRATS_IMAGES = {"T1CE MRI": "t1c", "T1 MRI": "t1n", "T2-FLAIR MRI": "t2f", "T2 MRI": "t2w"}
HAN_SEG = {
    "A_Carotid_L": "left carotid artery", "A_Carotid_R": "right carotid artery", "Arytenoid": "arytenoid cartilages", "Bone_Mandible": "mandible", "Brainstem": "brainstem", "BuccalMucosa": "buccal mucosa", "Cavity_Oral": "oral cavity",
    "Cochlea_L": "left cochlea", "Cochlea_R": "right cochlea", "Cricopharyngeus": "cricopharyngeus", "Esophagus_S": "cervical esophagus", "Eye_AL": "anterior segment of left eyeball", "Eye_AR": "anterior segment of right eyeball",
    "Eye_PL": "posterior segment of left eyeball", "Eye_PR": "posterior segment of right eyeball", "Glnd_Lacrimal_L": "left lacrimal gland", "Glnd_Lacrimal_R": "right lacrimal gland", "Glnd_Submand_L": "left submandibular gland",
    "Glnd_Submand_R": "right submandibular gland", "Glnd_Thyroid": "thyroid", "Glottis": "glottis", "Larynx_SG": "supraglottis", "Lips": "lip",
}
SEG_RAP = {
    "Brain": "brain", "BrainStem": "brainstem", "Chiasm": "optic chiasm", "TemporalLobe_L": "left temporal lobe", "TemporalLobe_R": "right temporal lobe", "Hippocampus_L": "left hippocampus", "Hippocampus_R": "right hippocampus",
    "Eye_L": "left eye", "Eye_R": "right eye", "Lens_L": "lens of left eye", "Lens_R": "lens of right eye", "OpticNerve_L": "left optic nerve", "OpticNerve_R": "right optic nerve", "MiddleEar_L": "left middle ear", "MiddleEar_R": "right middle ear",
    "IAC_L": "left internal auditory canal", "IAC_R": "right internal auditory canal", "TympanicCavity_L": "left tympanic cavity", "TympanicCavity_R": "right tympanic cavity", "VestibulSemi_L": "left semicircular canal",
    "VestibulSemi_R": "right semicircular canal", "Cochlea_L": "left cochlea", "Cochlea_R": "right cochlea", "ETbone_L": "left eustachian tube", "ETbone_R": "right eustachian tube", "Pituitary": "pituitary", "OralCavity": "oral cavity",
    "Mandible_L": "left mandible", "Mandible_R": "right mandible", "Submandibular_L": "left submandibular gland", "Submandibular_R": "right submandibular gland", "Parotid_L": "left parotid gland", "Parotid_R": "right parotid gland",
    "Mastoid_L": "left mastoid bone", "Mastoid_R": "right mastoid bone", "TMjoint_L": "left temporomandibular joint", "TMjoint_R": "right temporomandibular joint", "SpinalCord": "spinal cord", "Esophagus": "esophagus", "Larynx": "larynx",
    "Larynx_Glottic": "glottis", "Larynx_Supraglot": "supraglottis", "PharynxConst": "pharynx", "Thyroid": "thyroid", "Trachea": "trachea",
}
# MSD task, its classes and its semantic targets.
MSD = {
    "Task02_Heart": ({1: "left atrium"}, ()), "Task03_Liver": ({1: "liver", 2: "liver tumor"}, ("liver tumor",)), "Task04_Hippocampus": ({1: "anterior hippocampus", 2: "posterior hippocampus"}, ()),
    "Task05_Prostate": ({1: "peripheral zone of prostate", 2: "transition zone of prostate"}, ()), "Task06_Lung": ({1: "lung cancer"}, ("lung cancer",)), "Task07_Pancreas": ({1: "pancreas", 2: "pancreatic cancer"}, ("pancreatic cancer",)),
    "Task08_HepaticVessel": ({1: "hepatic vessel", 2: "liver tumor"}, ("liver tumor",)), "Task09_Spleen": ({1: "spleen"}, ()), "Task10_Colon": ({1: "colon cancer"}, ("colon cancer",)),
}
PELVIS = {1: "sacrum", 2: "right hip bone", 3: "left hip bone"}
CHAOS_MR = {63: "liver", 126: "right kidney", 189: "left kidney", 252: "spleen"}

# Fixed value: the ending of compressed image files.
_NII = r"\.nii\.gz$"

# File patterns and templates of the public datasets.
DATASETS = {
    d.name: d
    for d in (
        Dataset("ACDC", rf"^(.*/)?(patient[^/]*)/([^/]+)_gt{_NII}", "$3", {"cine MRI": "$1$2/$3.nii.gz"}, {1: "right ventricle cavity", 2: "myocardium", 3: "left ventricle cavity"}),
        Dataset("AMOS22", rf"^amos22/labels(Tr|Va)/(amos_(\d+)){_NII}", "$2", {"image": "amos22/images$1/$2.nii.gz"}, AMOS),
        Dataset("ATLAS", rf"^(Training/.*/anat/)([^/]+)_space-MNI152NLin2009aSym_label-L_desc-T1lesion_mask{_NII}", "$2", {"T1 MRI": "$1$2_space-MNI152NLin2009aSym_T1w.nii.gz"}, masks={"stroke lesion": "$0"}, semantic=frozenset({"stroke lesion"})),
        Dataset("ATM22", rf"^(TrainBatch[^/]*)/labelsTr/([^/]+){_NII}", "$2", {"CT": "$1/imagesTr/$2.nii.gz"}, masks={"airway": "$0"}, excluded=("ATM_164_0000",)),
        Dataset("BTCV/Abdomen", rf"^RawData/Training/label/label(\d{{4}}){_NII}", "$1", {"CT": "RawData/Training/img/img$1.nii.gz"}, BTCV_ABDOMEN),
        Dataset("BTCV/Cervix", rf"^RawData/Training/label/(.{{7}})-Mask{_NII}", "$1", {"CT": "RawData/Training/img/$1-Image.nii.gz"}, {1: "bladder", 2: "uterus", 3: "rectum", 4: "small intestine"}),
        Dataset("CHAOS/CT", r"^Train_Sets/CT/([^/]+)/Ground$", "CT-$1", {"CT": "Train_Sets/CT/$1/DICOM_anon"}, masks={"liver": "$0"}, complete=True),
        Dataset("CHAOS/T1DUAL", r"^Train_Sets/MR/([^/]+)/T1DUAL/Ground$", "MR-$1-T1DUAL-in", {"T1-DUAL (in-phase) MRI": "Train_Sets/MR/$1/T1DUAL/DICOM_anon/InPhase"}, CHAOS_MR, complete=True),
        Dataset("CHAOS/T2SPIR", r"^Train_Sets/MR/([^/]+)/T2SPIR/Ground$", "MR-$1-T2SPIR", {"T2-SPIR MRI": "Train_Sets/MR/$1/T2SPIR/DICOM_anon"}, CHAOS_MR, complete=True),
        Dataset("CT-ORG", rf"^labels-(\d+){_NII}", "$1", {"CT": "volume-$1.nii.gz"}, {1: "liver", 2: "bladder", 3: "lung", 4: "kidney"}, semantic=frozenset({"kidney", "lung"})),
        Dataset("CTSpine1K", rf"^CTSpine1K/[^/]+/gt/([^/]+)_seg{_NII}", "$1", {}, VERTEBRAE),
        Dataset("HaN-Seg", r"^set_1/(case_[^/]+)/[^/]+_IMG_CT\.nrrd$", "$1", {"CT": "$0"}, masks={n: f"set_1/$1/$1_OAR_{k}.seg.nrrd" for k, n in HAN_SEG.items()}),
        Dataset("ISLES22", rf"^derivatives/(.*/)([^/]+)_msk{_NII}", "$2", {"DW MRI": "$1dwi/$2_dwi.nii.gz", "ADC MRI": "$1dwi/$2_adc.nii.gz"}, masks={"stroke lesion": "$0"}, semantic=frozenset({"stroke lesion"})),
        Dataset("LNQ2023", r"^train/(lnq2023-train-[^/]+)-seg\.nrrd$", "$1", {"CT": "train/$1-ct.nrrd"}, masks={"mediastinal lymph node": "$0"}),
        Dataset("LiTS", r"^(Training Batch [^/]+)/segmentation-(\d+)\.nii$", "$2", {"CT": "$1/volume-$2.nii"}, {1: "liver", 2: "liver tumor"}, semantic=frozenset({"liver tumor"})),
        Dataset("MRSpineSeg", rf"^train/Mask/mask_(case([^/]*)){_NII}", "$1", {"T2 MRI": "train/MR/Case$2.nii.gz"}, MR_SPINE),
        Dataset("PARSE2022", rf"^train/([^/]+)/label/[^/]+{_NII}", "$1", {"CT": "train/$1/image/$1.nii.gz"}, masks={"pulmonary artery": "$0"}),
        Dataset("PENGWIN-T1", r"^PENGWIN_CT_train_images_part[^/]+/([^/]+)\.mha$", "$1", {"CT": "$0"}, masks={"label": "PENGWIN_CT_train_labels/$1.mha"}),
        Dataset("PENGWIN-T2", r"^train/input/images/x-ray/([^/]+)\.tif$", "$1", {"X-ray": "$0"}, masks={"label": "train/output/images/x-ray/$1.tif"}),
        Dataset("PI-CAI", rf"^picai_labels/csPCa_lesion_delineations/human_expert/resampled/(([^/_]+)_[^/]+){_NII}", "$1", {"T2 MRI": "$2/$1_t2w.mha"}, masks={"prostate cancer": "$0"}, semantic=frozenset({"prostate cancer"})),
        Dataset("RibFrac", rf"^(Part[^/]+)/(RibFrac[^/]+)-label{_NII}", "$2", {"CT": "$1/$2-image.nii.gz"}, masks={"rib fracture": "$0"}),
        Dataset("SEG.A.2023", r"^(.*/)([^/]+)\.seg\.nrrd$", "$2", {"CT angiography": "$1$2.nrrd"}, masks={"aortic vessel tree": "$0"}),
        Dataset("SegRap2023", rf"^SegRap2023_Training_Set_120cases/(segrap_\d{{4}})/image{_NII}", "$1", {"CT": "$0", "contrast-enhanced CT": "SegRap2023_Training_Set_120cases/$1/image_contrast.nii.gz"}, masks={n: f"SegRap2023_Training_Set_120cases_Update_Labels/$1/{k}.nii.gz" for k, n in SEG_RAP.items()}),
        Dataset("SegTHOR", rf"^train/(Patient_[^/]+)/GT{_NII}", "$1", {"CT": "train/$1/$1.nii.gz"}, {1: "esophagus", 2: "heart", 3: "trachea", 4: "aorta"}),
        Dataset("VerSe", rf"^(dataset-[^/]+)/derivatives/([^/]+)/([^/]+)_seg-vert_msk{_NII}", "$3", {"CT": "$1/rawdata/$2/$3_ct.nii.gz"}, VERTEBRAE),
        Dataset("WORD", rf"^labels(Tr|Val)/([^/]+){_NII}", "$2", {"CT": "images$1/$2.nii.gz"}, WORD),
        Dataset("WORD/LiTS", rf"^addition_validation_from_LiTS/lablesTs/([^/]+)_word_label{_NII}", "$1", {"CT": "../MSD/Task03_Liver/imagesTr/$1.nii.gz"}, WORD),
        Dataset("autoPET-III", rf"^labelsTr/([^/]+){_NII}", "$1", {"PET": "imagesTr/$1_0000.nii.gz", "CT": "imagesTr/$1_0001.nii.gz"}, masks={"tumor": "$0"}, complete=True, semantic=frozenset({"tumor"})),
        *(Dataset(f"BraTS2023/BraTS-{t}", rf"^(.*/)?(BraTS-{t}[^/]*)/[^/]+-seg{_NII}", "$2", {m: f"$1$2/$2-{s}.nii.gz" for m, s in BRATS_IMAGES.items()}, BRATS) for t in ("GLI", "MEN", "MET", "PED", "SSA")),
        *(Dataset(f"CTPelvic1K/{i}", rf"^CTPelvic1K_dataset{i}_mask(?:_mappingback)?/{f'dataset{i}_' if i < 7 else ''}(.+)_mask_4label{_NII}", "$1", {"CT": f"CTPelvic1K_dataset{i}_data/dataset{i}_$1_data.nii.gz"}, PELVIS) for i in range(1, 8)),
        *(Dataset(f"MSD/{t}", rf"^labelsTr/([^/.][^/]*){_NII}", "$1", {"_all": "imagesTr/$1.nii.gz"}, c, semantic=frozenset(s)) for t, (c, s) in MSD.items()),
    )
}


def _filled(template: str, path: str, pattern: str) -> Column:
    """The template with the groups of ``path``; a group that matched nothing is empty."""
    return F.regexp_replace(F.col(path), pattern, template)


def _table(entries: dict, kind: str) -> Column:
    """A literal map; empty for no entries."""
    if not entries:
        return F.expr(f"cast(map() as {kind})")
    return F.create_map(*(x if isinstance(x, Column) else F.lit(x) for pair in entries.items() for x in pair))


def cases(files: DataFrame, spec: Dataset) -> DataFrame:
    """``key, images, masks, label, class_mapping, complete_anomaly`` of every file of ``files(path)`` that is a case's label."""
    found = files.select("path").where(F.col("path").rlike(spec.label))
    images = _table({m: _filled(t, "path", spec.label) for m, t in spec.images.items()}, "map<string,string>")
    masks = F.array(*(F.struct(F.lit(n).alias("target"), _filled(t, "path", spec.label).alias("path")) for n, t in spec.masks.items())) if spec.masks else F.expr("cast(array() as array<struct<target:string,path:string>>)")
    out = found.select(
        F.lit(spec.name).alias("dataset"), _filled(spec.key, "path", spec.label).alias("key"), images.alias("images"), masks.alias("masks"),
        F.when(F.lit(bool(spec.classes)), F.col("path")).alias("label"), _table(spec.classes, "map<int,string>").alias("class_mapping"), F.lit(spec.complete).alias("complete_anomaly"),
    )
    return out.where(~F.col("key").isin(*spec.excluded)) if spec.excluded else out


def amos_cases(files: DataFrame, meta: DataFrame) -> DataFrame:
    """AMOS22 cases with modality by number, classes by the patient's sex of ``meta(amos_id, sex)``, and split by folder."""
    rows = cases(files, DATASETS["AMOS22"])
    number = F.regexp_extract("key", r"_(\d+)$", 1).cast("int")
    rows = rows.withColumn("amos_id", number).join(meta, "amos_id")
    by_sex = F.create_map(*(x for s, c in AMOS_BY_SEX.items() for x in (F.lit(s), _table(c, "map<int,string>"))))
    modality = F.when(F.col("amos_id") <= 500, "CT").otherwise("MRI")
    return rows.withColumns({
        "images": F.create_map(modality, F.col("images")["image"]), "class_mapping": by_sex[F.col("sex")],
        "split": F.when(F.contains("label", F.lit("labelsTr")), "train").otherwise("validate"),
    }).drop("amos_id", "sex")


def ct_org_cases(files: DataFrame) -> DataFrame:
    """CT-ORG cases; lungs are marked by hand, and so a class, only up to case 20."""
    rows = cases(files, DATASETS["CT-ORG"])
    return rows.withColumn("class_mapping", F.when(F.col("key").cast("int") <= 20, F.col("class_mapping")).otherwise(F.map_filter("class_mapping", lambda k, v: v != "lung")))


def acdc_cases(files: DataFrame, settings: DataFrame) -> DataFrame:
    """ACDC cases; a patient of group NOR in ``settings(path, settings)`` is complete."""
    patient = lambda c: F.regexp_extract(c, r"(patient[^/]*)/", 1)
    groups = settings.select(patient("path").alias("patient"), (F.col("settings")["Group"] == "NOR").alias("normal"))
    return cases(files, DATASETS["ACDC"]).withColumn("patient", patient("label")).join(groups, "patient").withColumn("complete_anomaly", F.col("normal")).drop("patient", "normal")


def busi_cases(files: DataFrame) -> DataFrame:
    """BUSI images with their 0 to n masks and grade."""
    pattern = r"^(?:.*/)?(normal|benign|malignant)/((?:normal|benign|malignant) \(\d+\))(_mask[^/]*)?\.png$"
    parts = files.where(F.col("path").rlike(pattern)).select("path", F.regexp_extract("path", pattern, 1).alias("grade"), F.regexp_extract("path", pattern, 2).alias("key"), (F.regexp_extract("path", pattern, 3) != "").alias("mask"))
    out = parts.groupBy("grade", "key").agg(F.max(F.when(~F.col("mask"), F.col("path"))).alias("image"), F.array_sort(F.collect_list(F.when(F.col("mask"), F.struct(F.lit("breast cancer").alias("target"), "path")))).alias("masks"))
    return out.where("image is not null").select(F.lit("BUSI").alias("dataset"), "key", F.create_map(F.lit("ultrasound"), "image").alias("images"), "masks", F.to_json(F.struct("grade")).alias("extra"), F.lit(True).alias("complete_anomaly"))


def prostate158_cases(splits: DataFrame) -> DataFrame:
    """Prostate158 cases of both split tables; the tumour mask may be missing."""
    masks = F.array_compact(F.array(F.struct(F.lit("anatomy").alias("target"), F.col("t2_anatomy_reader1").alias("path")), F.when(F.col("t2_tumor_reader1").isNotNull(), F.struct(F.lit("prostate cancer").alias("target"), F.col("t2_tumor_reader1").alias("path")))))
    return splits.select(F.lit("Prostate158").alias("dataset"), F.col("ID").alias("key"), F.create_map(F.lit("T2 MRI"), F.col("t2")).alias("images"), masks.alias("masks"))


def total_segmentator_cases(files: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """TotalSegmentator cases: each mask's file key is looked up in ``taxonomy(key, name)``; unknown keys are left out."""
    pattern = r"^(?:.*/)?([^/]+)/segmentations-zstd/([^/]+)\.nii\.zst$"
    masks = files.where(F.col("path").rlike(pattern)).select("path", F.regexp_extract("path", pattern, 1).alias("case"), F.regexp_extract("path", pattern, 2).alias("key"))
    named = masks.join(taxonomy.select("key", "name"), "key")
    out = named.groupBy("case").agg(F.array_sort(F.collect_list(F.struct(F.col("name").alias("target"), "path"))).alias("masks"))
    return out.select(F.lit("TotalSegmentator").alias("dataset"), F.col("case").alias("key"), F.create_map(F.lit("CT"), F.concat("case", F.lit("/ct.nii.gz"))).alias("images"), "masks")


def chexpert_cases(rows: DataFrame) -> DataFrame:
    """CheXpert rows (``Path`` and label columns) with keys patient-study-view."""
    from corvane.functions.labels import path_key

    return rows.select(F.lit("CheXpert").alias("dataset"), path_key(F.col("Path"), 3, 1).alias("key"), F.create_map(F.lit("X-ray"), F.col("Path")).alias("images"), *(c for c in rows.columns if c != "Path"))


def vindr_cases(objects: DataFrame, image_labels: DataFrame) -> DataFrame:
    """VinDr-CXR images that have both boxes and rater labels: boxes nested, a label held if any rater gave it."""
    classes = [c for c in image_labels.columns if c not in ("image_id", "rad_id")]
    boxes = objects.where("class_name <> 'Other lesion'").groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("class_name", "rad_id", "x_min", "y_min", "x_max", "y_max"))).alias("objects"))
    votes = image_labels.groupBy("image_id").agg(*((F.bool_and(F.col(f"`{c}`") == 1) if c == "No finding" else F.bool_or(F.col(f"`{c}`") == 1)).alias(c) for c in classes))
    return boxes.join(votes, "image_id")


def pelvic_fragments(labels: DataFrame) -> DataFrame:
    """Of ``labels(key, value)`` the number of distinct fragments of each of three bones, ten label values each."""
    count = lambda i: F.countDistinct(F.when(F.col("value").between(i * 10 + 1, (i + 1) * 10), F.col("value")))
    return labels.groupBy("key").agg(*(count(i).alias(n) for i, n in enumerate(("sacrum", "left hip bone", "right hip bone"))))


def merged_targets(cells: DataFrame, key: list[str], target: str, sources: dict[str, list[str]], dropped: list[str] = ()) -> DataFrame:
    """Mask cells with derived targets: each is the union of its sources; ``dropped`` targets go."""
    table = {}
    for made, parts in sources.items():
        for p in parts:
            table.setdefault(p, []).append(made)
    names = F.create_map(*(x for p, made in table.items() for x in (F.lit(p), F.array(*map(F.lit, made)))))
    own = F.when(F.col(target).isin(*dropped), F.array().cast("array<string>")).otherwise(F.array(target)) if dropped else F.array(target)
    every = F.concat(own, F.coalesce(F.try_element_at(names, F.col(target)), F.array().cast("array<string>")))
    return cells.withColumn(target, F.explode(F.array_distinct(every))).dropDuplicates([*key, target])


def source_of(name: str) -> str:
    """A dataset's output name: no slashes."""
    return re.sub(r"/", "-", name)
