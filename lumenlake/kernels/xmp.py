"""XMP packets: RDF descriptions as properties. Entities and document types are refused."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from functools import lru_cache

from lumenlake.kernels.limits import DEFAULT, Limits, ParseError, need
from lumenlake.kernels.names import XMP_PREFIXES

_RDF = "{http://www.w3.org/1999/02/22-rdf-syntax-ns#}"
_LANG = "{http://www.w3.org/XML/1998/namespace}lang"


def tree(packet: bytes, limits: Limits = DEFAULT) -> ET.Element:
    packet = packet.rstrip(b"\0")
    need(bool(packet), "XMP packet is empty")
    need(len(packet) <= limits.max_xmp_packet_bytes, "XMP packet exceeds the limit")
    upper = packet.upper()
    need(b"<!DOCTYPE" not in upper and b"<!ENTITY" not in upper, "XMP packet declares a document type or entity")
    try:
        text = packet.decode("utf-8-sig")
        root = ET.fromstring(text.strip())
    except (UnicodeDecodeError, ET.ParseError) as e:
        raise ParseError(f"XMP is not well-formed: {e}") from None
    need(sum(1 for _ in root.iter()) <= limits.max_xmp_xml_nodes, "XMP has too many nodes")
    return root


def split(name: str) -> tuple[str | None, str, str]:
    """Namespace, local and qualified name; a namespace without a known prefix stays expanded."""
    if name.startswith("{") and "}" in name:
        space, local = name[1:].split("}", 1)
        prefix = XMP_PREFIXES.get(space)
        return space, local, f"{prefix}:{local}" if prefix else name
    return None, name, name


def _text(e: ET.Element) -> str:
    return (e.text or "").strip()


def _value(e: ET.Element) -> str | list[str] | None:
    """Resource, then Alt (x-default or the first), Seq, Bag, then text; None where nothing is said."""
    if (resource := e.get(f"{_RDF}resource")) is not None:
        return resource
    if (alt := e.find(f"{_RDF}Alt")) is not None:
        items = alt.findall(f"{_RDF}li")
        chosen = next((x for x in items if x.get(_LANG) == "x-default"), items[0] if items else None)
        return None if chosen is None else _text(chosen) or None
    for kind in ("Seq", "Bag"):
        if (bag := e.find(_RDF + kind)) is not None:
            return [t for x in bag.findall(f"{_RDF}li") if (t := _text(x))] or None
    return _text(e) or None


def properties(packet: bytes, limits: Limits = DEFAULT) -> list[dict]:
    out: list[dict] = []

    def add(name: str, value: str | list[str] | None) -> None:
        if value is not None:
            need(len(out) < limits.max_xmp_properties, "XMP has too many properties")
            space, local, qualified = split(name)
            many = isinstance(value, list)
            out.append({"pos": len(out), "namespace_uri": space, "local_name": local, "qualified_name": qualified, "value_text": None if many else value, "value_list": value if many else None})

    for d in tree(packet, limits).iter(f"{_RDF}Description"):
        for name, value in d.attrib.items():
            if name != f"{_RDF}about":
                add(name, value)
        for child in d:
            add(child.tag, _value(child))
    return out


#: White space as the rules take it: what Unicode calls so.
BLANK = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def filled(found: list[dict]) -> list[str]:
    """Local names, in small letters, of the properties that have a value."""
    return list(dict.fromkeys(p["local_name"].lower() for p in found if p["value_list"] or (p["value_text"] or "").strip(BLANK)))


@lru_cache(1024)
def names_filled(packet: bytes, limits: Limits = DEFAULT) -> tuple[str, ...]:
    """``filled`` of a packet's properties; many files have the same packet."""
    return tuple(filled(properties(packet, limits)))


def sanitize(packet: bytes, private: frozenset[str], limits: Limits = DEFAULT) -> bytes | None:
    """The packet without properties whose local name starts with gps, is hasextendedxmp or is in ``private``; None if none goes."""
    root, removed = tree(packet, limits), 0

    def drop(name: str) -> bool:
        local = split(name)[1].rsplit(":", 1)[-1].casefold()
        return local.startswith("gps") or local == "hasextendedxmp" or local in private

    todo = [root]
    while todo:
        e = todo.pop()
        for name in [n for n in e.attrib if drop(n)]:
            del e.attrib[name]
            removed += 1
        gone = [child for child in e if isinstance(child.tag, str) and drop(child.tag)]
        for child in gone:
            e.remove(child)
        removed += len(gone)
        todo += list(e)
    return serialise(root) if removed else None


def _quoted(text: str, attribute: bool = False) -> str:
    text = text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    return text.replace('"', "&quot;").replace("\r", "&#13;").replace("\n", "&#10;").replace("\t", "&#09;") if attribute else text


def serialise(root: ET.Element) -> bytes:
    """A document as UTF-8, its namespaces declared at the root; without recursion, as hostile packets nest deep."""
    prefixes = {"http://www.w3.org/XML/1998/namespace": "xml"}

    def name(qualified: str) -> str:
        if qualified[:1] != "{":
            return qualified
        space, local = qualified[1:].split("}", 1)
        if space not in prefixes:
            prefixes[space] = XMP_PREFIXES.get(space) or f"ns{len(prefixes)}"
        return f"{prefixes[space]}:{local}"

    out: list[str] = []
    todo: list[ET.Element | str] = [root]
    while todo:
        e = todo.pop()
        if isinstance(e, str):
            out.append(e)
            continue
        tag = name(e.tag)
        attributes = "".join(f' {name(k)}="{_quoted(v, True)}"' for k, v in e.attrib.items())
        out.append(f"<{tag}{attributes}")
        if e is root:
            at = len(out)
        inside = bool(len(e)) or bool(e.text)
        out.append(">" + _quoted(e.text or "") if inside else " />")
        todo.append((f"</{tag}>" if inside else "") + (_quoted(e.tail or "") if e is not root else ""))
        todo += reversed(list(e))
    spaces = "".join(f' xmlns:{p}="{_quoted(s, True)}"' for s, p in prefixes.items() if p != "xml")
    return ("<?xml version='1.0' encoding='utf-8'?>\n" + "".join([*out[:at], spaces, *out[at:]])).encode()
