"""Schemas of the tables that the kernels make."""

from __future__ import annotations

VALUE = "struct<kind:string,is_scalar:boolean,ints:array<bigint>,rationals:array<struct<num:bigint,den:bigint>>,floats:array<double>,text:string,bytes:binary>"
SEGMENT = (
    "struct<seq:int,offset:bigint,marker:int,name:string,declared_length:int,payload_length:int,is_exif:boolean,is_xmp:boolean,"
    "is_extended_xmp:boolean,is_icc:boolean,is_photoshop:boolean>"
)
#: A segment as a row of its own: what a file's windows and groups take.
SEGMENT_ROW = SEGMENT[:-1] + ",late:boolean,head:binary,payload:binary,gps:string,camera_model:string,problem:string>"
TAG = f"struct<ifd:string,pos:int,tag:int,tag_name:string,field_type:int,field_type_name:string,count:bigint,value:{VALUE}>"
XMP = "struct<packet:int,pos:int,namespace_uri:string,local_name:string,qualified_name:string,value_text:string,value_list:array<string>>"
IPTC = "struct<pos:int,record:int,dataset:int,name:string,text:string,raw:binary,encoding:string>"
ICC = (
    "struct<size:bigint,cmm:string,version:string,profile_class:string,color_space:string,pcs:string,platform:string,"
    "tags:array<struct<signature:string,offset:bigint,size:bigint>>,name:string>"
)
PRESENCE = "struct<exif:string,gps:string,xmp:string,iptc:string,icc:string,camera_model:string,warnings:array<string>>"
FINDING = "struct<code:string,severity:string,category:string,message:string,evidence:array<string>>"
#: One row per JPEG, as ``kernels.photo.parse`` makes it; ``location`` and ``capture`` are made of its tags (``functions.places``).
PHOTO = (
    f"width int, height int, segments array<{SEGMENT}>, tags array<{TAG}>, xmp array<{XMP}>, iptc array<{IPTC}>, icc {ICC}, "
    f"has array<string>, has_xmp array<string>, presence {PRESENCE}, jpeg_process string, scan_sha256 string, scan_bytes bigint, trailing_bytes bigint, quantization string, "
    f"huffman string, exif_segments int, structural array<{FINDING}>, has_extended_xmp boolean, errors array<struct<part:string,message:string>>"
)
CHANGE = "struct<seq:int,offset:bigint,marker:int,name:string,reason:string,removed:boolean,old_bytes:bigint,new_bytes:bigint>"
SCRUB = f"clean binary, changes array<{CHANGE}>, scan_before string, scan_after string, idempotent boolean, error string"
_SUMMARY = "make string, model string, software string, artist string, datetime_original string, orientation int, warnings array<string>"
CONTAINER = (
    "detected string, mime string, width int, height int, mode string, frames int, animated boolean, exif string, gps string, xmp string, icc string, "
    f"{_SUMMARY}, error string"
)
HEIF = (
    "format string, mime string, width int, height int, mode string, images int, bit_depth int, chroma int, has_alpha boolean, exif string, gps string, xmp string, "
    f"icc string, nclx string, other_blocks int, {_SUMMARY}, error string"
)
RAW = (
    "raw_width int, raw_height int, width int, height int, top_margin int, left_margin int, crop_width int, crop_height int, pixel_aspect double, flip int, raw_type string, "
    "num_colors int, color_description string, white_level int, black_level array<int>, camera_white_level array<int>, camera_white_balance array<double>, "
    "daylight_white_balance array<double>, iso_speed double, shutter_speed double, aperture double, focal_length double, timestamp string, shot_order int, artist string, "
    "lens_make string, lens_model string, lens_min_focal double, lens_max_focal double, error string"
)
EXIFTOOL = "payload string, error string"
