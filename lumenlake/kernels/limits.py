"""Budgets for hostile input."""

from __future__ import annotations

from dataclasses import dataclass

MIB = 1 << 20


@dataclass(frozen=True)
class Limits:
    """The default budgets. Any of them can be overridden per query."""

    max_input_file_bytes: int = 1024 * MIB
    max_jpeg_segments: int = 4096
    max_jpeg_marker_fill_bytes: int = 1024
    max_jpeg_segment_payload_bytes: int = 65533
    max_jpeg_header_payload_bytes: int = 32 * MIB
    max_ifd_entries: int = 4096
    max_tiff_components: int = 65536
    max_tiff_value_bytes: int = 16 * MIB
    max_ifd_depth: int = 16
    max_ifd_nodes: int = 64
    max_xmp_packet_bytes: int = 2 * MIB
    max_xmp_xml_nodes: int = 20000
    max_xmp_properties: int = 10000
    max_icc_profile_bytes: int = 32 * MIB
    max_icc_chunks: int = 255
    max_icc_tags: int = 4096
    max_photoshop_resources: int = 4096
    max_photoshop_payload_bytes: int = 16 * MIB
    max_photoshop_resource_bytes: int = 8 * MIB
    max_iptc_data_bytes: int = 16 * MIB
    max_iptc_datasets: int = 10000
    max_iptc_value_bytes: int = 8 * MIB
    max_iptc_length_octets: int = 8


DEFAULT = Limits()


class ParseError(Exception):
    """A blob breaks its format or a budget."""


def need(ok: bool, message: str) -> None:
    if not ok:
        raise ParseError(message)
