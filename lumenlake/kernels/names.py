"""Names of tags. Fixed values, in order of their ids."""

from __future__ import annotations

IFD0 = {
    0x0100: "ImageWidth", 0x0101: "ImageLength", 0x0102: "BitsPerSample", 0x0103: "Compression", 0x0106: "PhotometricInterpretation", 0x010E: "ImageDescription",
    0x010F: "Make", 0x0110: "Model", 0x0111: "StripOffsets", 0x0112: "Orientation", 0x0115: "SamplesPerPixel", 0x0116: "RowsPerStrip", 0x0117: "StripByteCounts",
    0x011A: "XResolution", 0x011B: "YResolution", 0x011C: "PlanarConfiguration", 0x0128: "ResolutionUnit", 0x0131: "Software", 0x0132: "DateTime", 0x013B: "Artist",
    0x013E: "WhitePoint", 0x013F: "PrimaryChromaticities", 0x0211: "YCbCrCoefficients", 0x0212: "YCbCrSubSampling", 0x0213: "YCbCrPositioning",
    0x0214: "ReferenceBlackWhite", 0x8298: "Copyright", 0x8769: "ExifIFDPointer", 0x8825: "GPSInfoIFDPointer",
}
EXIF = {
    0x829A: "ExposureTime", 0x829D: "FNumber", 0x8822: "ExposureProgram", 0x8827: "PhotographicSensitivity", 0x8830: "SensitivityType", 0x8831: "StandardOutputSensitivity",
    0x8832: "RecommendedExposureIndex", 0x8833: "ISOSpeed", 0x8834: "ISOSpeedLatitudeyyy", 0x8835: "ISOSpeedLatitudezzz", 0x9000: "ExifVersion", 0x9003: "DateTimeOriginal",
    0x9004: "DateTimeDigitized", 0x9101: "ComponentsConfiguration", 0x9102: "CompressedBitsPerPixel", 0x9201: "ShutterSpeedValue", 0x9202: "ApertureValue",
    0x9203: "BrightnessValue", 0x9204: "ExposureBiasValue", 0x9205: "MaxApertureValue", 0x9206: "SubjectDistance", 0x9207: "MeteringMode", 0x9208: "LightSource",
    0x9209: "Flash", 0x920A: "FocalLength", 0x927C: "MakerNote", 0x9286: "UserComment", 0xA001: "ColorSpace", 0xA002: "PixelXDimension", 0xA003: "PixelYDimension",
    0xA401: "CustomRendered", 0xA402: "ExposureMode", 0xA403: "WhiteBalance", 0xA404: "DigitalZoomRatio", 0xA405: "FocalLengthIn35mmFilm", 0xA406: "SceneCaptureType",
    0xA407: "GainControl", 0xA408: "Contrast", 0xA409: "Saturation", 0xA40A: "Sharpness", 0xA420: "ImageUniqueID", 0xA430: "CameraOwnerName", 0xA431: "BodySerialNumber",
    0xA432: "LensSpecification", 0xA433: "LensMake", 0xA434: "LensModel", 0xA435: "LensSerialNumber",
}
GPS = {
    0x00: "GPSVersionID", 0x01: "GPSLatitudeRef", 0x02: "GPSLatitude", 0x03: "GPSLongitudeRef", 0x04: "GPSLongitude", 0x05: "GPSAltitudeRef", 0x06: "GPSAltitude",
    0x07: "GPSTimeStamp", 0x08: "GPSSatellites", 0x09: "GPSStatus", 0x0A: "GPSMeasureMode", 0x0B: "GPSDOP", 0x0C: "GPSSpeedRef", 0x0D: "GPSSpeed", 0x0E: "GPSTrackRef",
    0x0F: "GPSTrack", 0x10: "GPSImgDirectionRef", 0x11: "GPSImgDirection", 0x12: "GPSMapDatum", 0x1B: "GPSProcessingMethod", 0x1C: "GPSAreaInformation",
    0x1D: "GPSDateStamp", 0x1E: "GPSDifferential", 0x1F: "GPSHPositioningError",
}
IPTC = {
    (1, 90): "CodedCharacterSet", (2, 5): "ObjectName", (2, 25): "Keywords", (2, 40): "SpecialInstructions", (2, 55): "DateCreated", (2, 60): "TimeCreated",
    (2, 80): "Byline", (2, 85): "BylineTitle", (2, 90): "City", (2, 92): "Sublocation", (2, 95): "ProvinceState", (2, 100): "CountryCode", (2, 101): "CountryName",
    (2, 103): "OriginalTransmissionReference", (2, 105): "Headline", (2, 110): "Credit", (2, 115): "Source", (2, 116): "CopyrightNotice", (2, 120): "CaptionAbstract",
    (2, 122): "WriterEditor",
}
XMP_PREFIXES = {
    "http://www.w3.org/1999/02/22-rdf-syntax-ns#": "rdf",
    "http://purl.org/dc/elements/1.1/": "dc",
    "http://ns.adobe.com/xap/1.0/": "xmp",
    "http://ns.adobe.com/photoshop/1.0/": "photoshop",
    "http://ns.adobe.com/camera-raw-settings/1.0/": "crs",
    "http://ns.adobe.com/xap/1.0/mm/": "xmpMM",
    "http://ns.adobe.com/exif/1.0/": "exif",
    "http://ns.adobe.com/tiff/1.0/": "tiff",
    "http://ns.google.com/photos/1.0/camera/": "gcamera",
}
_TABLES = {"IFD0": (IFD0, "UnknownTag"), "ExifIFD": (EXIF, "UnknownExifTag"), "GPS": (GPS, "UnknownGpsTag")}


def tag_name(ifd: str, tag: int) -> str:
    table, unknown = _TABLES[ifd]
    return table.get(tag) or f"{unknown}_{tag:04X}"
