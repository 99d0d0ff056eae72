"""One parser for each kind of document: a text in, entries (rows of schema.ENTRY as dicts) out. A bad document gives none."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from typing import Any
from urllib.parse import quote

from lexiforge.functions.dom import Node, page_text, parse
from lexiforge.functions.markup import (
    acute,
    is_abbreviation,
    language_section,
    nfc_lower,
    read_etymology,
    read_grammar,
    read_headword,
    read_register,
    render,
    split_homonym,
    split_senses,
    squeeze,
    strip_bracketed,
    template_params,
    wiki_sections,
    wiki_text,
)
from lexiforge.schema import AUTHORITY, DEFAULT_AUTHORITY, PROVIDERS

Entry = dict[str, Any]
_RELATIONS = ("synonyms", "antonyms", "diminutives", "augmentatives", "hypernyms")
_META = {p[0]: (p[1], p[2], p[8]) for p in PROVIDERS}
# Where a provider's pages are.
URLS = {
    "dexonline": "https://dexonline.ro/definitie/", "wiktionary": "https://ro.wiktionary.org/wiki/", "doom": "https://doom.lingv.ro/cautare/q/",
    "mdex": "https://m.dex.ro/?word=", "dlr": "https://dlr1.solirom.ro/index.php?cuv=", "forvo": "https://forvo.com/word/",
}


def entry_id(*parts: Any) -> str:
    return hashlib.sha256("\x01".join(map(str, parts)).encode()).hexdigest()[:26]


def relations(**lists: list[str]) -> dict:
    return {k: lists.get(k, []) for k in _RELATIONS}


def grow(tops: list[dict]) -> list[dict]:
    """The pre-order array of nested nodes (dicts with children)."""
    out: list[dict] = []

    def put(node: dict, parent: int | None, depth: int) -> None:
        at = len(out)
        out.append({
            "node_id": at, "parent_id": parent, "depth": depth, "number": node.get("number"), "text": node["text"], "type": node.get("type", "meaning"),
            "register": node.get("register", []), "domain": node.get("domain"), "citation": node.get("citation"), "sources": node.get("sources", []),
            "relations": node.get("relations") or relations(),
        })
        for child in node.get("children", []):
            put(child, at, depth + 1)

    for t in tops:
        put(t, None, 0)
    return out


def make(provider: str, word: str, display: str, ident: Any, senses: list[dict], *, pos: str = "unknown", authority: int | None = None, source: str | None = None, **more: Any) -> Entry:
    name, license_, own = _META[provider]
    low = nfc_lower(display)
    said = {k: None for k in ("ipa", "stress_mark", "syllabification", "audio_url", "audio_mime", "audio_attribution")}
    return {
        "provider_id": provider, "headword": low, "id": entry_id(provider, low, ident), "ord": 0, "display_headword": display,
        "homonym_index": more.get("homonym"), "part_of_speech": pos, "gender": more.get("gender"),
        "inflections": [{"form": f, "tags": t, "origin": "attested", "confidence": "high"} for f, t in more.get("inflections", [])],
        "paradigm": more.get("paradigm"), "pronunciations": [said | p for p in more.get("pronunciations", [])], "senses": grow(senses),
        "etymology": more.get("etymology"), "derived": [], "compounds": [],
        "source": {
            "provider_id": provider, "provider_name": name, "source_name": source, "work_title": source, "authority": own if authority is None else authority,
            "url": URLS.get(provider, "") + quote(word, safe="!'()*"), "license": license_, "attribution": f"{name} — {source}" if source else name, "cache_hit": False,
        },
    }


def _json(body: str) -> dict:
    try:
        found = json.loads(body)
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}


# ---- JSON of definitions ----------------------------------------------------------------------------------------


def dexonline(body: str, word: str) -> list[Entry]:
    out = []
    for i, d in enumerate(_json(body).get("definitions") or []):
        raw = d.get("internalRep") or ""
        r = render(raw)
        senses = split_senses(r) if r.text else []
        if not senses:
            continue
        head, source = read_headword(raw), d.get("sourceName") or "DEXonline"
        at = r.text.find(senses[0].text)
        grammar = read_grammar(r.text[: at if at > 0 else 120] or r.text[:120])
        kind = lambda x: "sub-meaning" if x.marker == "**" else "expression" if re.search(r"\bexpr\b", x.text, re.I | re.A) else "locution"
        node = lambda text, **more: {"text": text, "register": read_register(text), "sources": [source], **more}  # noqa: E731,B023
        nodes = [node(s.text, number=s.number, children=[node(x.text, type=kind(x)) for x in s.items]) for s in senses]
        origin = read_etymology(r.text)
        out.append(make(
            "dexonline", word, head.lemma if head else word, d.get("id") or i, nodes, pos=grammar.pos, gender=grammar.gender, source=source,
            authority=AUTHORITY.get(source, DEFAULT_AUTHORITY), homonym=head and head.homonym, pronunciations=[{"stress_mark": head.stressed}] if head and head.stressed else [],
            etymology=origin and {"text": origin[0], "languages": origin[1]},
        ))
    return out


def forvo(body: str, word: str) -> list[Entry]:
    items = _json(body).get("items") or []
    said = [{"audio_url": x["pathmp3"], "audio_mime": "audio/mpeg", "audio_attribution": x.get("username")} for x in items if x.get("pathmp3")]
    return [make("forvo", word, items[0].get("word") or word, 0, [], pronunciations=said)] if said else []


# ---- wiki -------------------------------------------------------------------------------------------------------

# Parameters of inflection templates and the tags they stand for.
_PARAMS = {
    "nom-sg": ("nominative", "singular"),
    "nom-pl": ("nominative", "plural"),
    "art-sg": ("articulated", "singular"),
    "art-pl": ("articulated", "plural"),
    "dat-sg": ("dative", "genitive", "singular"),
    "dat-pl": ("dative", "genitive", "plural"),
    "voc-sg": ("vocative", "singular"),
    "voc-pl": ("vocative", "plural"),
    "inf": ("infinitive",),
    "ind": ("indicative", "present"),
    "conj": ("subjunctive", "present"),
    "part": ("participle",),
    "ger": ("gerund",),
}
# Names of parts of speech, and of languages of origin.
_POS = ("substantiv", "verb", "adjectiv", "adverb", "pronume", "numeral", "prepoziție", "conjuncție", "interjecție", "articol", "expresie", "locuțiune")
_ORIGINS = ("latină", "franceză", "germană", "engleză", "greacă", "slavă", "turcă", "maghiară", "rusă", "italiană", "bulgară", "sârbă", "ucraineană")


def _wiki_senses(lines: list[str]) -> list[dict]:
    out: list[dict] = []
    for line in lines:
        m = re.match(r"#+([:*]*)(.*)", line)
        text = wiki_text(m[2]) if m else ""
        if not text:
            continue
        if not line.startswith(("#:", "#*")):
            text = wiki_text(line.lstrip("#")) if m[1] else text
            out.append({"number": len(out) + 1, "text": text, "register": read_register(text), "children": []})
        elif out:
            out[-1]["children"].append({"text": text, "type": "example"})
    return out


def wiktionary(body: str, word: str) -> list[Entry]:
    found = _json(body)
    page = found.get("parse") or {}
    text = language_section(page.get("wikitext") or "") if not found.get("error") else ""
    if not text.strip():
        return []
    sections = wiki_sections(text)
    by_name = {s.name.lower(): s for s in reversed(sections)}
    listed = lambda name: [t for x in (by_name[name].lines if name in by_name else []) for p in wiki_text(x.strip().lstrip("*")).split(",") if (t := p.strip())]
    main = next((s for s in sections if s.name.lower().strip("-") in _POS), None)
    pos = main.name.lower().strip("-") if main else "unknown"
    senses = _wiki_senses(main.lines) if main else []
    if senses:
        senses[0]["relations"] = relations(synonyms=listed("-sin-"), antonyms=listed("-ant-"))
    ipa = [re.sub(r",(?=[a-zɐ-ʯ])", "ˌ", x.replace("'", "ˈ")) for x in re.findall(r"(?i)\{\{\s*AFI\s*\|\s*([^}|]+?)\s*\}\}", text)]
    origin = squeeze(" ".join(wiki_text(x) for x in by_name["-etimologie-"].lines)) if "-etimologie-" in by_name else ""
    params = template_params(text, f"{pos}-ron") or {}
    forms = dict.fromkeys((form, tags) for k, v in params.items() if (tags := _PARAMS.get(k)) and (form := wiki_text(v)))
    if not (senses or ipa or origin or forms):
        return []
    gender = re.search(r"(?i)\{\{\s*([fmn])\s*\}\}", params.get("gen", ""))
    roman = params.get("cj")
    return [make(
        "wiktionary", page.get("title") or word, page.get("title") or word, 0, senses, pos=pos, gender=gender and {"f": "feminin", "m": "masculin", "n": "neutru"}[gender[1].lower()],
        inflections=[(f, list(t)) for f, t in forms], pronunciations=[{"ipa": x} for x in dict.fromkeys(ipa)],
        etymology={"text": origin, "languages": [x for x in _ORIGINS if x in origin.lower()]} if origin else None,
        paradigm={"model_code": None, "class_roman": roman, "cells": []} if roman else None,
    )]


# ---- spelling dictionary ----------------------------------------------------------------------------------------

# Labels in front of forms, the first that is found counts, and their tags.
_LABELS = [(re.compile(p, re.I | re.A), t.split()) for p, t in (
    (r"ind\.?\s*prez\.?\s*(\d)\s*(sg|pl)\b", "indicative present"), (r"ind\.?\s*imperf\.?\s*(\d)\s*(sg|pl)\b", "indicative imperfect"),
    (r"perf\.?\s*s\.?\s*(\d)\s*(sg|pl)\b", "indicative simple-perfect"), (r"m\.m\.c\.p\.?\s*(\d)\s*(sg|pl)\b", "indicative pluperfect"),
    (r"conj\.?\s*prez\.?\s*(\d)?\s*(sg|pl)?\b", "subjunctive present"), (r"imper\.?\s*(\d)?\s*(sg|pl)?\b", "imperative"), (r"ger\.?\b", "gerund"), (r"part\.?\b", "participle"),
    (r"inf\.?\s*lg\.?\b", "infinitive long"), (r"g\.?\s*-?\s*d\.?\s*art\.?\b", "genitive dative articulated"), (r"g\.?\s*-?\s*d\.?\b", "genitive dative"),
    (r"voc\.?\b", "vocative"), (r"pl\.?\s*art\.?\b", "plural articulated"), (r"pl\.?\b", "plural"), (r"art\.?\b", "articulated"),
)]
_BARE = re.compile(r"(\d)\s*(sg|pl)?\.?", re.I)


def _stress(node: Node) -> int:
    """Where in the node's text the first underlined run begins; -1 without one."""
    at = 0
    for owner, text in node.runs():
        if any(n.style("text-decoration", "underline") for n in (owner, *owner.above())):
            return at
        at += len(text)
    return -1


def _tags(label: str, tense: list[str]) -> tuple[list[str], list[str]]:
    """Tags of a label, and the tense that later labels of a bare person take."""
    label = label.strip()
    m, tags = _BARE.fullmatch(label), tense
    if not m:
        m, tags = next(((m, t) for p, t in _LABELS if (m := p.search(label))), (None, []))
    if not m or not tags:
        return [], tense
    person, number = (*m.groups(), None, None)[:2]
    kept = tags if {"indicative", "subjunctive", "imperative"} & set(tags) else tense
    more = [f"person:{person}"] if person else []
    return [*tags, *more, *(["plural" if number.lower() == "pl" else "singular"] if number else [])], kept


def _forms(text: str) -> list[str]:
    bare = re.sub(r"(?i)^(?:să|a)\s+", "", strip_bracketed(text.replace("\xa0", " ")))
    bare = re.sub(r"[.,;:]+$", "", bare).strip()
    return [] if is_abbreviation(bare) else [f for p in bare.split(",") if (f := p.strip()) and not is_abbreviation(f)]


def _doom_entry(fragment: str, word: str, i: int) -> Entry | None:
    root = parse(fragment)
    bold = root.first("span", where=lambda n: n.style("font-weight", "bold"))
    if not bold:
        return None
    sup = bold.first("sup")
    homonym = sup.text() if sup else ""
    if sup:
        sup.drop()
    lemma = bold.text()
    if is_abbreviation(lemma):
        return None
    hint = next((t for n in root.all("span", "doom-tooltip") if "-" in (t := n.raw().strip())), None)
    # outermost italic elements that are not bold, with the places of their texts
    text, spans = "", []
    for owner, run in root.runs():
        chain = [owner, *owner.above()]
        italic = None if bold in chain else next((n for n in reversed(chain) if n.style("font-style", "italic") and not n.style("font-weight", "bold")), None)
        if italic is not None and spans and spans[-1][0] is italic:
            spans[-1][2] += len(run)
        elif italic is not None:
            spans.append([italic, len(text), len(text) + len(run)])
        text += run
    text = text.replace("\xa0", " ")
    depth = 0
    depths = []
    for c in text:
        depth += c in "(["
        depths.append(depth)
        depth = max(0, depth - (c in ")]"))
    found: dict[tuple, None] = {}
    start, tense = 0, []
    for _, a, b in spans:
        if a < len(depths) and depths[a]:
            continue  # an aside; the label of the next form goes on
        tags, tense = _tags(strip_bracketed(re.split("[,;]", text[start:a])[-1]), tense)
        start = b
        for form in _forms(text[a:b]) if tags else []:
            found[form, tuple(tags)] = None
    grammar = read_grammar(strip_bracketed(text))
    mark = acute(lemma, _stress(bold))
    said = {k: v for k, v in (("stress_mark", mark), ("syllabification", hint)) if v}
    return make(
        "doom", word, lemma, int(homonym) if homonym.isdigit() else i, [], pos=grammar.pos, gender=grammar.gender, source="DOOM 3",
        inflections=[(f, list(t)) for f, t in found], pronunciations=[said] if said else [],
    )


def doom(body: str, word: str) -> list[Entry]:
    out, want = [], nfc_lower(word).strip()
    for m in re.finditer(r"(?is)<entry\b[^>]*>(.*?)</entry>", body):
        entry = _doom_entry(m[1], word, len(out))
        if entry and entry["headword"] == want:
            out.append(entry)
    return out


# ---- mirrors ----------------------------------------------------------------------------------------------------


def _numbered(text: str, examples: list[str]) -> list[dict]:
    parts = re.split(r"(?:^|[\s(])([0-9]+)\.\s+", text)
    if len(parts) < 5:
        body = re.sub(r"^[,;:.\s]+", "", re.sub(r"(?i)^(?:[a-zăâîșț]{1,6}\.\s*){1,4}", "", text))
        pairs = [(1, squeeze(body))]
    else:
        pairs = [(int(n), squeeze(t)) for n, t in zip(parts[1::2], parts[2::2], strict=True)]
    pairs = [(i, n, t) for i, (n, t) in enumerate(pairs) if t]
    children = [{"text": t, "type": "example"} for t in examples[:3]]
    return [{"number": n, "text": t, "register": read_register(t), "children": children if i == 0 else []} for i, n, t in pairs]


def mdex(body: str, word: str) -> list[Entry]:
    out = []
    for block in parse(body).all(cls="mydef"):
        for node in block.all("button script style"):
            node.drop()
        source = None
        for node in block.all("span"):
            if m := re.search(r"(?i)Sursa\s*:\s*(.*)", node.raw()):
                source = source or re.sub(r"[)\s]+$", "", m[1]) or None
                if node.parent:
                    node.drop()
        strong, text = block.first("strong"), block.text()
        if len(text) < 8:
            continue
        lead = strong.raw().strip() if strong else ""
        lemma, homonym = split_homonym(lead)
        rest = text[len(lead) :].lstrip() if lead and text.startswith(lead) else text
        quotes = [t for n in block.all("i em blockquote") if 4 < len(t := n.text()) < 200]
        senses, grammar = _numbered(rest, quotes), read_grammar(rest[:60])
        if senses:
            out.append(make("mdex", word, lemma or word, len(out), senses, pos=grammar.pos, gender=grammar.gender, source=source, homonym=homonym))
    return out


def dlr(body: str, word: str) -> list[Entry]:
    out = []
    for node in parse(body).all(where=lambda n: n.tag == "article" or {"entry", "articol"} & set(n.classes) or (n.tag == "div" and n.attrs.get("id") == "articol")):
        text = page_text(node.raw())
        if len(text) < 20:
            continue
        title = node.first(where=lambda n: n.tag in ("h1", "h2") or (n.tag == "h3" and "lemma" in n.classes) or {"lemma", "titlu"} & set(n.classes))
        display = next(iter(title.text().split()), word) if title else word
        parts = [t for n in node.all(where=lambda n: (n.tag == "p" and {"def", "sens"} & set(n.classes)) or "definition" in n.classes) if (t := page_text(n.raw()))]
        out.append(make("dlr", word, display, len(out), [{"number": i, "text": t} for i, t in enumerate(parts or [text], 1)]))
    return out


# ---- the rendered page: meaning trees and paradigms -----------------------------------------------------------------

# Names of relation lists.
_LISTS = {"sinonime": "synonyms", "antonime": "antonyms", "diminutive": "diminutives", "augmentative": "augmentatives", "hiperonime": "hypernyms"}


def _tree_node(li: Node) -> dict | None:
    kind = next((c[5:] for c in li.classes if c in ("type-meaning", "type-example", "type-expression", "type-etymology")), None)
    box = next(iter(li.own("div", "meaningContainer")), None)
    row = next(iter(box.own("div", "meaning-row")), None) if box else None
    label = row.first(cls="tree-def") if row else None
    if not kind or not label or not (text := label.text()):
        return None
    citation = None
    if kind == "example" and (quoted := label.first("i em")) and (inner := quoted.text()):
        citation = text[text.find(inner) + len(inner) :].strip() or None
        text = inner
    lists: dict[str, dict] = {}
    for group in (g for r in box.own("div", "meaning-relations")[:1] for g in r.all(cls="tag-group")):
        name = group.first(cls="text-muted")
        if key := _LISTS.get(name.text().rstrip(":").lower() if name else ""):
            words = [a.text() for b in group.all(cls="badge-relation") for a in b.all("a")]
            lists.setdefault(key, {}).update(dict.fromkeys(w for w in words if w))
    number = row.first(cls="bc")
    leading = re.match("[0-9]+", number.text()) if number else None
    return {
        "text": text, "type": kind, "citation": citation, "number": int(leading[0]) if leading else None, "relations": relations(**{k: list(v) for k, v in lists.items()}),
        "sources": list(dict.fromkeys(t for b in row.all(cls="badge-source") if (t := b.text()))),
        "children": [c for ul in li.own("ul", "meaningTree") for x in ul.own("li") if (c := _tree_node(x))],
    }


def meaning_trees(html: str) -> list[dict]:
    """pos_info and nodes (pre-order) of each top tree of a page."""
    out = []
    for ul in parse(html).all("ul", "meaningTree"):
        if any(n.tag == "li" for n in ul.above()):
            continue
        nodes = [n for li in ul.own("li") if (n := _tree_node(li))]
        card = next((n.parent for n in ul.above() if "tree-body" in n.classes), None)
        info = card.first(cls="tree-pos-info") if card else None
        if nodes:
            out.append({"pos_info": (info.text() or None) if info else None, "nodes": grow(nodes)})
    return out


# Words of cell labels and their tags.
_CELL = [(re.compile(p, re.I | re.A), t.split()) for p, t in (
    (r"nominativ[-\s]*acuzativ", "nominative accusative"), (r"genitiv[-\s]*dativ", "genitive dative"), (r"\bvocativ", "vocative"), (r"\bnominativ", "nominative"),
    (r"\bacuzativ", "accusative"), (r"\bgenitiv", "genitive"), (r"\bdativ", "dative"), (r"infinitiv\s+lung", "infinitive long"), (r"\binfinitiv", "infinitive"),
    (r"\bgerunziu", "gerund"), (r"\bparticipiu", "participle"), (r"\bimperativ", "imperative"), (r"\bconjunctiv", "subjunctive"), (r"\bindicativ", "indicative"),
    (r"\bprezent", "present"), (r"\bimperfect", "imperfect"), (r"perfect\s+simplu", "simple-perfect"), (r"mai\s+mult\s+ca\s+perfect", "pluperfect"),
)]
_PERSONS = [re.compile(p, re.A) for p in (r"(?i)\b(?:persoana|pers\.)\s*(?:a\s*)?(I{1,3}|[123])", r"(?i:(?:^|\s)a?)\s*(I{1,3})(?:-a)?\s*\(", r"(?:^|\s)([123])(?:\s|$)")]


def cell_tags(label: str) -> list[str]:
    out = [t for p, tags in _CELL if p.search(label) for t in tags]
    out += [n for n in ("singular", "plural") if re.search(rf"(?ia)\b{n}\b", label)]
    out += ["unarticulated"] if re.search(r"(?ia)\bnearticulat\b", label) else ["articulated"] if re.search(r"(?ia)\barticulat\b", label) else []
    person = next((m[1].upper() for p in _PERSONS if (m := p.search(label))), None)
    return list(dict.fromkeys(out + ([f"person:{len(person) if person[0] == 'I' else person}"] if person else [])))


def _grid(table: Node) -> list[list[tuple[Node, bool]]]:
    """Cells by row and column, with whether a place is the cell's own; a cell stands in every place that it spans."""
    places: dict[tuple[int, int], tuple[Node, bool]] = {}
    count = lambda td, name: max(1, int(v)) if (v := td.attrs.get(name, "1")).isdigit() else 1
    for r, tr in enumerate(table.all("tr")):
        c = 0
        for td in tr.own("td"):
            while (r, c) in places:
                c += 1
            for dr in range(count(td, "rowspan")):
                for dc in range(count(td, "colspan")):
                    places[r + dr, c + dc] = (td, dr == dc == 0)
            c += count(td, "colspan")
    rows: dict[int, dict[int, tuple[Node, bool]]] = {}
    for (r, c), cell in places.items():
        rows.setdefault(r, {})[c] = cell
    return [rows[r] for r in sorted(rows)]


def read_table(table: Node) -> tuple[list[dict], list[tuple[str, list[str]]]]:
    """Cells (tags, forms) and distinct forms. Rows without forms name their columns; in others, labels left of the forms
    name the row and those right of them qualify their columns."""
    heads: dict[int, str] = {}
    subs: dict[int, str] = {}
    cells, forms = [], {}
    for row in _grid(table):
        form_at = sorted(c for c, (td, _) in row.items() if "form" in td.classes)
        labels = {c: t for c, (td, _) in sorted(row.items()) if "inflection" in td.classes and "form" not in td.classes and (t := td.text())}
        if not form_at:
            heads |= labels
            subs = {}
            continue
        subs |= {c: t for c, t in labels.items() if c > form_at[0]}
        names = list(dict.fromkeys(t for c, t in labels.items() if c < form_at[0]))
        for c in form_at:
            td, own = row[c]
            found = [t for li in td.all("li") if (t := li.text())]
            if not own or not found:
                continue
            label = " ".join(x for x in (heads.get(c), subs.get(c), *names) if x)
            tags = cell_tags(label)
            cells.append({"tags": tags or [label or td.text()], "forms": found})
            forms |= {(f, tuple(tags)): None for f in found if tags}
    return cells, [(f, list(t)) for f, t in forms]


def paradigms(html: str) -> list[dict]:
    """lexeme, label, pos_info, paradigm and inflections of each table of a page."""
    out = []
    for div in parse(html).all(cls="paradigmDiv"):
        name, table = div.first(cls="lexemeName"), div.first("table", "lexeme")
        if div.first(cls="noParadigm") or not name or not name.text() or not table:
            continue
        cells, forms = read_table(table)
        if not cells:
            continue
        inner = lambda outer, tag: next((n.text() or None for o in div.all(cls=outer) for n in o.all(tag)), None)  # noqa: E731,B023
        code = table.first("a", where=lambda n: "/model-flexiune/" in n.attrs.get("href", ""))
        out.append({
            "lexeme": name.text(), "label": inner("card-header", "strong"), "pos_info": inner("tag", "a"),
            "paradigm": {"model_code": code.text() if code else None, "class_roman": None, "cells": cells},
            "inflections": [{"form": f, "tags": t, "origin": "attested", "confidence": "high"} for f, t in forms],
        })
    return out


PARSERS = {"dexonline": dexonline, "wiktionary": wiktionary, "forvo": forvo, "doom": doom, "mdex": mdex, "dlr": dlr}


def entries_of(provider: str | None, word: str | None, body: str | None) -> Iterator[Entry]:
    """Entries of a document with their order."""
    if provider in PARSERS and body and body.strip():
        for i, e in enumerate(PARSERS[provider](body, word or "")):
            yield e | {"ord": i}
