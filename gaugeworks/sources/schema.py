"""Schemas of project files, sidecars and the normalized tables."""

from __future__ import annotations

_POINT = "struct<x:double,y:double>"
_LINE = f"struct<start:{_POINT},end:{_POINT}>"
CALIBRATION = "struct<mode:string,pixels_per_unit:double,unit:string,source_label:string>"
GROUP = "struct<id:string,image_id:string,number:int,color:string,label:string,name:string>"
MEASUREMENT = (
    f"struct<id:string,image_id:string,fiber_group_id:string,mode:string,measurement_kind:string,line_px:{_LINE},"
    f"snapped_line_px:{_LINE},polyline_px:array<{_POINT}>,point_px:{_POINT},polygon_px:array<{_POINT}>,"
    f"area_rings_px:array<array<{_POINT}>>,exact_area_px:double,confidence:double,status:string,created_at:string,"
    "debug_payload:string>"
)
ANNOTATION = f"struct<id:string,kind:string,content:string,anchor:{_POINT},start:{_POINT},end:{_POINT},created_at:string>"
PRESET = "struct<name:string,pixels_per_unit:double,unit:string,pixel_distance:double,actual_distance:double,computed_pixels_per_unit:double>"
TEMPLATE = "struct<label:string,color:string>"
DOCUMENT = (
    f"struct<id:string,path:string,source_type:string,absolute_path:string,image_size:array<int>,calibration:{CALIBRATION},"
    f"fiber_groups:array<{GROUP}>,measurements:array<{MEASUREMENT}>,overlay_annotations:array<{ANNOTATION}>,"
    f"text_annotations:array<{ANNOTATION}>,metadata:string,active_group_id:string,suppressed_project_group_labels:array<string>,"
    "image_pos:int,first_measurement:int>"
)
#: A project file. One of a project in parts says which part it is; its images then say where they stand, and an image with
#: many measurements is listed again with the further ones.
PROJECT = (
    f"version string, documents array<{DOCUMENT}>, calibration_presets array<{PRESET}>, project_default_calibration {CALIBRATION}, "
    f"project_group_templates array<{TEMPLATE}>, metadata string, part struct<project:string,number:int>"
)
#: A calibration sidecar beside an image.
SIDECAR = f"version string, image_path string, calibration {CALIBRATION}, calibration_line {_LINE}, updated_at string"
#: Image files that a folder scan takes.
IMAGE_SUFFIXES = ("png", "jpg", "jpeg", "bmp", "tif", "tiff")
