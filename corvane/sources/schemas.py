"""Schemas of the records, as Spark DDL."""

from __future__ import annotations

IMAGE = "struct<path:string,modality:string,plane:string>"
PAIR = "struct<question:string,answer:string>"
STUDY = f"dataset string, split string, key string, image array<{IMAGE}>, findings string, impression string, processed_report string, processed_caption string, anomaly_pos array<string>, anomaly_neg array<string>, vqa array<{PAIR}>"
TAG = "struct<phrase:string,target:string,start:int,end:int>"
GROUNDED = f"{STUDY}, tagged_findings string, filtered_tagged_findings string, ref_report string, tags array<{TAG}>"
SECTION = "study_id string, pos int, name string, text string, start_idx int"
TAXONOMY = "name string, category string, synonyms array<string>, parents array<string>"
CASE = "key string, images map<string,string>, complete_anomaly boolean, extra string, masks array<struct<target:string,path:string>>, label string, class_mapping map<int,string>"
TARGET = "struct<name:string,semantic:boolean,position_offset:array<int>,index_offset:array<int>,mask_sizes:array<bigint>,boxes:array<array<bigint>>>"
SPARSE = f"spacing array<double>, shape array<bigint>, modalities array<string>, mean array<float>, std array<float>, targets map<string,array<{TARGET}>>, neg_targets map<string,array<string>>, complete_anomaly boolean, extra string"
OBJECTS = "image_id string, rad_id string, class_name string, x_min double, y_min double, x_max double, y_max double"
PREDICTIONS = "question string, answer string, prediction string"
DETECTIONS = "image_id string, det_no int, class string, score double, x1 double, y1 double, x2 double, y2 double"
MOT_TRUTH = "frame int, id int, x double, y double, w double, h double, mark int, label int"
TRACK_OBSERVATION = "seq string, frame int, slot int, score double"
MIXTURE = "name string, type string, weight double"
