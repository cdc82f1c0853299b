"""What a PDF says about itself beside its pages: tags, forms, outline, links, metadata."""

from __future__ import annotations

from typing import Any

from .content import rgb, text_string, tokens
from .document import Document
from .objects import Name, Ref, Stream

SIBLINGS = 10_000
NODES = 250_000
# Standard structure roles and the kinds of node they make: fixed values of the standard's vocabulary.
ROLES = {
    "Document": "document", "Part": "section", "Art": "section", "Sect": "section", "Div": "section", "NonStruct": "section", "BlockQuote": "quote", "Caption": "caption", "TOC": "toc", "TOCI": "toc_item", "Index": "section",
    "P": "paragraph", "H": "heading", "H1": "heading", "H2": "heading", "H3": "heading", "H4": "heading", "H5": "heading", "H6": "heading", "Title": "heading", "L": "list", "LI": "item", "Lbl": "label", "LBody": "item_body",
    "Table": "table", "TR": "table_row", "TH": "table_cell", "TD": "table_cell", "THead": "table_section", "TBody": "table_section", "TFoot": "table_section", "Span": "span", "Quote": "span", "Note": "note", "FENote": "note", "Reference": "reference",
    "BibEntry": "reference", "Code": "code", "Link": "link", "Annot": "annotation", "Figure": "figure", "Formula": "formula", "Form": "form", "Aside": "section", "Em": "emphasis", "Strong": "strong", "Sub": "span", "Artifact": "artifact",
}
FLAGS = {"readonly": 1, "required": 1 << 1, "noexport": 1 << 2, "multiline": 1 << 12, "password": 1 << 13, "radio": 1 << 15, "pushbutton": 1 << 16, "combo": 1 << 17, "comb": 1 << 24}


def _text(doc: Document, value: Any) -> str | None:
    value = doc.resolve(value)
    return text_string(value) if isinstance(value, bytes) else str(value) if isinstance(value, Name) else None


def page_numbers(doc: Document) -> dict[int, int]:
    return {p.ref.num: p.number for p in doc.pages() if p.ref}


def tagged_nodes(doc: Document) -> list[dict[str, Any]]:
    """The structure tree in adjacency form: node, parent, ordinal, role, kind, page, mcids and own texts.

    A role is followed through the role map until it is a standard one; a map that leads back to itself gives none.
    """
    root = doc.dict_of(doc.catalog().get("StructTreeRoot"))
    if not root and not any(["StructParents" in p.attrs for p in doc.pages()]):
        return []
    roles = {str(k): str(v) for k, v in ((k, doc.resolve(v)) for k, v in doc.dict_of(root.get("RoleMap")).items()) if isinstance(v, Name)}
    pages = page_numbers(doc)
    owners = _parent_tree(doc, root)
    out: list[dict[str, Any]] = []
    seen: set[int] = set()
    stack: list[tuple[Any, int | None, int, int | None, str | None]] = [(k, None, i, None, None) for i, k in reversed(list(enumerate(_kids(doc, root))))]
    while stack and len(out) < NODES:
        raw, parent, ordinal, page, lang = stack.pop()
        if isinstance(raw, Ref):
            if raw.num in seen:
                doc.warn("TAG_TREE_CYCLE")
                continue
            seen.add(raw.num)
        node = doc.resolve(raw)
        if not isinstance(node, dict) or "S" not in node:
            continue
        page = pages.get(node["Pg"].num, page) if isinstance(node.get("Pg"), Ref) else page
        lang = _text(doc, node.get("Lang")) or lang
        role, met = str(doc.resolve(node["S"])), set()
        while role not in ROLES and role in roles and role not in met:
            met.add(role)
            role = roles[role]
        number = len(out)
        mcids, children, objects = [], [], 0
        for kid in _kids(doc, node):
            value = doc.resolve(kid)
            if isinstance(value, int):
                mcids.append((page, value))
            elif isinstance(value, dict) and doc.resolve(value.get("Type")) == "MCR":
                at = pages.get(value["Pg"].num, page) if isinstance(value.get("Pg"), Ref) else page
                mcids.append((at, doc.resolve(value.get("MCID"))))
            elif isinstance(value, dict) and doc.resolve(value.get("Type")) == "OBJR":
                objects += 1
            elif isinstance(value, dict):
                children.append(kid)
        held = bool(mcids) and isinstance(raw, Ref) and all(owners.get((p, m)) == raw.num for p, m in mcids)
        out.append({
            "node": number, "parent": parent, "ordinal": ordinal, "role": role, "kind": ROLES.get(role, "section"), "page": page, "lang": lang, "mcids": [{"page": p, "mcid": m} for p, m in mcids], "objects": objects,
            "alt": _text(doc, node.get("Alt")), "actual_text": _text(doc, node.get("ActualText")), "title": _text(doc, node.get("T")), "confidence": 0.995 if held else 0.94,
        })
        stack += [(c, number, i, page, lang) for i, c in reversed(list(enumerate(children)))]
    return out


def _kids(doc: Document, node: dict[str, Any]) -> list:
    kids = node.get("K")
    value = doc.resolve(kids)
    return value if isinstance(value, list) else [] if value is None else [kids]


def _number_tree(doc: Document, root: Any) -> dict[int, Any]:
    out: dict[int, Any] = {}
    todo, seen = [root], set()
    while todo:
        raw = todo.pop()
        if isinstance(raw, Ref):
            if raw.num in seen:
                continue
            seen.add(raw.num)
        node = doc.dict_of(raw)
        nums = doc.list_of(node.get("Nums"))
        out.update({k: v for k, v in zip(nums[::2], nums[1::2], strict=False) if isinstance(k, int)})
        todo += doc.list_of(node.get("Kids"))
    return out


def _parent_tree(doc: Document, root: dict[str, Any]) -> dict[tuple[int | None, int], int]:
    """Which structure element owns each marked content: (page, mcid) to object number."""
    entries = _number_tree(doc, root.get("ParentTree"))
    out = {}
    for page in doc.pages():
        key = doc.resolve(page.attrs.get("StructParents"))
        for mcid, owner in enumerate(doc.list_of(entries.get(key))):
            if isinstance(owner, Ref):
                out[page.number, mcid] = owner.num
    return out


def form_fields(doc: Document) -> list[dict[str, Any]]:
    """Terminal fields: qualified name, type, kind, flags, value, options and the pages of their widgets.

    Inherited keys come from the nearest ancestor; a password's value is not given away; no action is run.
    """
    form = doc.dict_of(doc.catalog().get("AcroForm"))
    pages = page_numbers(doc)
    on_page = {a.num: p.number for p in doc.pages() for a in doc.list_of(p.attrs.get("Annots")) if isinstance(a, Ref)}
    out: list[dict[str, Any]] = []
    seen: set[int] = set()
    stack = [(f, {}, ()) for f in reversed(doc.list_of(form.get("Fields")))]
    while stack and len(out) < NODES:
        raw, inherited, names = stack.pop()
        if isinstance(raw, Ref):
            if raw.num in seen:
                doc.warn("FIELD_CYCLE")
                continue
            seen.add(raw.num)
        node = doc.dict_of(raw)
        state = {**inherited, **{k: node[k] for k in ("FT", "Ff", "V", "DV", "Opt", "MaxLen") if k in node}}
        part = _text(doc, node.get("T"))
        here = (*names, part) if part else names
        kids = doc.list_of(node.get("Kids"))
        widgets = [k for k in kids if "T" not in doc.dict_of(k)]
        if kids and len(widgets) < len(kids):
            stack += [(k, state, here) for k in reversed(kids)]
            continue
        own = widgets or [raw]
        kind, flags = str(doc.resolve(state.get("FT")) or ""), doc.resolve(state.get("Ff"))
        flags = flags if isinstance(flags, int) else 0
        found = sorted({p for w in own if (p := _widget_page(doc, w, pages, on_page)) is not None})
        value = "[redacted]" if kind == "Tx" and flags & FLAGS["password"] else _value(doc, state.get("V"))
        out.append({
            "name": ".".join(here), "type": kind, "kind": field_kind(kind, flags), "flags": sorted(k for k, v in FLAGS.items() if flags & v), "value": value, "options": [_option(doc, o) for o in doc.list_of(state.get("Opt"))],
            "states": sorted({s for w in own for s in _states(doc, w)}), "pages": found, "label": _text(doc, node.get("TU")), "appearance": _uniform([widget_appearance(doc, w) for w in own]),
        })
    return out


def _uniform(found: list[dict[str, Any]]) -> dict[str, Any] | None:
    """The appearance of a field's widgets if all of them agree."""
    return found[0] if found and all(f == found[0] for f in found) else None


def field_kind(kind: str, flags: int) -> str:
    if kind == "Btn":
        return "pushbutton" if flags & FLAGS["pushbutton"] else "radio" if flags & FLAGS["radio"] else "checkbox"
    if kind == "Ch":
        return "combo" if flags & FLAGS["combo"] else "listbox"
    return "signature" if kind == "Sig" else "text"


def _widget_page(doc: Document, raw: Any, pages: dict[int, int], on_page: dict[int, int]) -> int | None:
    p = doc.dict_of(raw).get("P")
    if isinstance(p, Ref) and p.num in pages:
        return pages[p.num]
    return on_page.get(raw.num) if isinstance(raw, Ref) else None


def _value(doc: Document, raw: Any) -> str | None:
    value = doc.resolve(raw)
    if isinstance(value, list):
        return ", ".join(filter(None, (_text(doc, v) for v in value)))
    return str(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else _text(doc, raw)


def _option(doc: Document, raw: Any) -> str:
    value = doc.resolve(raw)
    return _text(doc, value[-1]) or "" if isinstance(value, list) and value else _text(doc, raw) or ""


def _states(doc: Document, raw: Any) -> list[str]:
    normal = doc.resolve(doc.dict_of(doc.dict_of(raw).get("AP")).get("N"))
    return [str(k) for k in normal if k != "Off"] if isinstance(normal, dict) else []


APPEARANCE_BYTES = 262_144


def widget_appearance(doc: Document, raw: Any) -> dict[str, Any]:
    """What a widget's appearance stream shows: its last text's font, size and colour, and a background that covers its box.

    The stream counts, not the declared look (DA, MK), which is passed on under `declared` alone.
    """

    node = doc.dict_of(raw)
    normal = doc.resolve(doc.dict_of(node.get("AP")).get("N"))
    if isinstance(normal, dict):
        state = doc.resolve(node.get("AS"))
        live = [k for k in normal if k != "Off"]
        normal = doc.resolve(normal.get(str(state))) if state in normal else doc.resolve(normal[live[0]]) if len(live) == 1 else None
    declared = {k: _text(doc, doc.dict_of(node).get(k)) for k in ("DA",) if k in node}
    out: dict[str, Any] = {"declared": declared, "align": {0: "left", 1: "center", 2: "right"}.get(doc.resolve(node.get("Q")), "left")}
    if not isinstance(normal, Stream):
        return out
    box = doc.numbers(normal.attrs.get("BBox"))
    fill, rects = (0.0, 0.0, 0.0), []
    font: tuple[str, float] | None = None
    stack: list[tuple] = []
    for op, args in tokens(doc.bytes_of(normal)[:APPEARANCE_BYTES]):
        values = [float(a) for a in args if isinstance(a, (int, float))]
        if op == "q" and len(stack) < 64:
            stack.append((fill, font))
        elif op == "Q" and stack:
            fill, font = stack.pop()
        elif op in ("g", "rg", "k") and values:
            fill = rgb({"g": "gray", "rg": "rgb", "k": "cmyk"}[op], values)
        elif op == "Tf" and len(args) == 2:
            font = (str(args[0]), float(args[1]))
        elif op == "re" and len(values) == 4:
            rects.append(values)
        elif op in ("f", "F", "f*", "B", "b"):
            for x, y, w, h in rects:
                if len(box) == 4 and x <= box[0] + 1 and y <= box[1] + 1 and x + w >= box[2] - 1 and y + h >= box[3] - 1:
                    out["background"] = list(fill)
            rects = []
        elif op in ("S", "s", "n"):
            rects = []
        elif op in ("Tj", "TJ", "'", '"'):
            out |= {"text_color": list(fill), "font": font[0] if font else None, "size": font[1] if font else None}
    return out


def outline(doc: Document) -> list[dict[str, Any]]:
    """Outline entries in adjacency form, destinations resolved: node, parent, level, title, page, y."""
    if doc.catalog().keys().isdisjoint(("Outlines", "Dests", "Names")):
        return []
    pages = page_numbers(doc)
    named = _named_destinations(doc)
    out: list[dict[str, Any]] = []
    seen: set[int] = set()

    def siblings(first: Any, parent: int | None, level: int) -> None:
        raw, count = first, 0
        while isinstance(raw, Ref) and raw.num not in seen and count < SIBLINGS and level <= 64:
            seen.add(raw.num)
            node = doc.dict_of(raw)
            dest = node.get("Dest", doc.dict_of(node.get("A")).get("D") if doc.resolve(doc.dict_of(node.get("A")).get("S")) == "GoTo" else None)
            page, y = _destination(doc, dest, named, pages)
            number = len(out)
            out.append({"node": number, "parent": parent, "level": level, "title": _text(doc, node.get("Title")) or "", "page": page, "y": y})
            siblings(node.get("First"), number, level + 1)
            raw, count = node.get("Next"), count + 1

    siblings(doc.dict_of(doc.catalog().get("Outlines")).get("First"), None, 1)
    return out


def _named_destinations(doc: Document) -> dict[str, Any]:
    out = dict(doc.dict_of(doc.catalog().get("Dests")))
    todo, seen = [doc.dict_of(doc.catalog().get("Names")).get("Dests")], set()
    while todo:
        raw = todo.pop()
        if isinstance(raw, Ref):
            if raw.num in seen:
                continue
            seen.add(raw.num)
        node = doc.dict_of(raw)
        names = doc.list_of(node.get("Names"))
        out.update({_text(doc, k) or "": v for k, v in zip(names[::2], names[1::2], strict=False)})
        todo += doc.list_of(node.get("Kids"))
    return out


def _destination(doc: Document, dest: Any, named: dict[str, Any], pages: dict[int, int]) -> tuple[int | None, float | None]:
    value = doc.resolve(dest)
    if isinstance(value, (bytes, Name)):
        value = doc.resolve(named.get(_text(doc, value) or ""))
    if isinstance(value, dict):
        value = doc.resolve(value.get("D"))
    if not isinstance(value, list) or not value:
        return None, None
    page = pages.get(value[0].num) if isinstance(value[0], Ref) else value[0] + 1 if isinstance(value[0], int) else None
    mode = value[1] if len(value) > 1 else None
    spot = value[3] if mode == "XYZ" and len(value) > 3 else value[2] if mode in ("FitH", "FitBH") and len(value) > 2 else None
    return page, float(spot) if isinstance(spot, (int, float)) else None


def links(doc: Document) -> list[dict[str, Any]]:
    """Link annotations: page, box, address or destination page."""
    pages, named, out = page_numbers(doc), _named_destinations(doc), []
    for page in doc.pages():
        for raw in doc.list_of(page.attrs.get("Annots")):
            node = doc.dict_of(raw)
            box = doc.numbers(node.get("Rect"))
            if doc.resolve(node.get("Subtype")) != "Link" or len(box) != 4:
                continue
            action = doc.dict_of(node.get("A"))
            uri = _text(doc, action.get("URI")) if doc.resolve(action.get("S")) == "URI" else None
            target, y = _destination(doc, node.get("Dest", action.get("D")), named, pages)
            out.append({"page": page.number, "x0": min(box[0], box[2]), "y0": min(box[1], box[3]), "x1": max(box[0], box[2]), "y1": max(box[1], box[3]), "uri": uri, "target_page": target, "target_y": y})
    return out


def metadata(doc: Document) -> dict[str, str | None]:
    info = doc.dict_of(doc.trailer.get("Info"))
    found = {k.lower(): _text(doc, info.get(k)) for k in ("Title", "Author", "Producer", "Creator")}
    return {**found, "lang": _text(doc, doc.catalog().get("Lang"))}


def embedded_images(doc: Document) -> list[Stream]:
    """Image streams of a file, each once."""
    return [x for n in sorted(doc.places) if isinstance(x := doc.get(n), Stream) and doc.resolve(x.attrs.get("Subtype")) == "Image"]
