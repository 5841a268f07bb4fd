"""HTML pages to text, sections, links and records: one Arrow pass over the pages with the standard parser.

A page is read into a light list of events once; each extractor is a small function over that list."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

SKIPPED = {"script", "style", "nav", "header", "footer", "aside", "form"}
VOID = {"br", "img", "hr", "meta", "link", "input", "area", "base", "col", "source", "wbr"}
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}")
PHONE = re.compile(r"\d{3}-\d{3}-\d{4}")
#: A tag without peculiarities and the text after it; an attribute of it. In some elements all is text.
ATTRIBUTE = re.compile(r"""[ \n]([a-zA-Z][a-zA-Z-]*)=("[^"<>]*"|'[^'<>]*')""")
PLAIN = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:(?<!/)[ \n][a-zA-Z][a-zA-Z-]*=(?:"[^"<>]*"|'[^'<>]*'))*)>([^<>]*)""")
TEXTUAL = {"script", "style", "title", "textarea", "plaintext", "xmp", "iframe", "noembed", "noframes", "noscript"}


class Reader(HTMLParser):
    """events: (kind, tag, attributes or text, path of open tags)."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.events: list[tuple[str, str, object, tuple[str, ...]]] = []
        self.open: list[str] = []
        if not self.plain(html):
            self.feed(html)
            self.close()

    def plain(self, html: str) -> bool:
        """Reads a page of nothing but texts and tags of PLAIN, as the parser would but in one search; False for any other page."""
        found = PLAIN.findall(html)
        if len(found) != html.count("<") or len(found) != html.count(">") or any(tag.lower() in TEXTUAL or end and attrs for end, tag, attrs, _ in found):
            return False
        self.handle_data(unescape(html.partition("<")[0]))
        events, path = self.events, ()
        for end, tag, attrs, text in found:
            tag = tag.lower()
            if not end:
                events.append(("start", tag, {k.lower(): unescape(v[1:-1]) for k, v in ATTRIBUTE.findall(attrs)} if attrs else {}, path))
                path = path if tag in VOID else (*path, tag)
            elif tag in path:
                path = path[: -1 - path[::-1].index(tag)]
                events.append(("end", tag, None, path))
            if text and (value := " ".join((unescape(text) if "&" in text else text).split())):
                events.append(("text", path[-1] if path else "", value, path))
        self.open = list(path)
        return True

    def handle_starttag(self, tag, attrs):
        self.events.append(("start", tag, dict(attrs), tuple(self.open)))
        if tag not in VOID:
            self.open.append(tag)

    def handle_endtag(self, tag):
        if tag in self.open:  # what was left open inside ends too
            while self.open.pop() != tag:
                pass
            self.events.append(("end", tag, None, tuple(self.open)))

    def handle_data(self, data):
        if data.strip():
            self.events.append(("text", self.open[-1] if self.open else "", " ".join(data.split()), tuple(self.open)))


def texts(events: list) -> list[tuple[str, str, tuple[str, ...]]]:
    return [(tag, text, path) for kind, tag, text, path in events if kind == "text" and not SKIPPED.intersection(path)]


def main_text(html: str) -> str:
    """Visible text outside navigation and the like: of <main> or <article> where there is one."""
    found = texts(Reader(html).events)
    for container in ("main", "article"):
        inside = [t for _, t, path in found if container in path]
        if inside:
            return "\n".join(inside)
    return "\n".join(t for _, t, path in found if "head" not in path)


def heading_sections(html: str) -> list[tuple[str, str]]:
    out: list[tuple[str, list[str]]] = []
    for _, text, path in texts(Reader(html).events):
        if any(re.fullmatch(r"h[1-6]", p) for p in path):
            out.append((text, []))
        elif out:
            out[-1][1].append(text)
    return [(h, "\n".join(body)) for h, body in out if body]


def next_text(events: list, at: int) -> str:
    return next((value for kind, _, value, _ in events[at:] if kind == "text"), "")


#: A room: a number and a building; what looks like one but isn't.
OFFICE = re.compile(r"\b\d{2,4}[A-Z]? [A-Z][a-z]+ (?:Hall|Building|Center)\b")
NO_OFFICE = ("suite", "box", "street", "avenue")


def office_of(sections: dict[str, str], whole: str) -> str | None:
    """The first line under a heading on the office, else the first room in the text that no denied word is in."""
    named = next((b for h, b in sections.items() if "office" in h.lower() or "location" in h.lower()), None)
    if named:
        return named.split("\n")[0]
    return next((m[0] for m in OFFICE.finditer(whole) if not any(x in m[0].lower() for x in NO_OFFICE)), None)


def person(html: str) -> dict | None:
    """Name (h1), title (the first element of class "title", else up to three list items), e-mail, phone, office,
    research topics and biography of a profile page; None without a name."""
    events = Reader(html).events
    found = texts(events)
    name = next((t for _, t, path in found if "h1" in path), None)
    if not name:
        return None
    mail = next((x["href"][7:] for kind, tag, x, _ in events if kind == "start" and tag == "a" and (x.get("href") or "").startswith("mailto:")), None)
    whole = "\n".join(t for _, t, _ in found)
    sections = dict(heading_sections(html))
    research = next((b for h, b in sections.items() if "research" in h.lower()), "")
    items = [x for line in research.split("\n") for x in re.split(r"\s*[,;]\s*", line) if x]
    bio = next((b for h, b in sections.items() if "bio" in h.lower()), None) or next((t for tag, t, _ in found if tag == "p" and len(t) > 200), None)
    titles = [next_text(events, i) for i, (kind, _, x, _) in enumerate(events) if kind == "start" and "title" in (x.get("class") or "").split()][:1] or [t for tag, t, _ in found if tag == "li"][:3]
    email, phone = EMAIL.search(whole), PHONE.search(whole.replace("+1-", ""))
    return {"name": name, "title": "; ".join(titles) or None, "email": mail or (email and email[0]), "phone": phone and phone[0], "office": office_of(sections, whole), "research": "; ".join(items) or None, "biography": bio}


def cards(html: str) -> list[dict]:
    """Person cards: blocks (div, li, article) without blocks inside that have an e-mail."""
    out, stack = [], []
    for kind, tag, value, _ in Reader(html).events:
        if kind == "start" and tag in ("div", "li", "article"):
            if stack:
                stack[-1]["inner"] = True
            stack.append({"texts": [], "mail": None, "inner": False})
        elif kind == "start" and tag == "a" and stack and (value.get("href") or "").startswith("mailto:"):
            stack[-1]["mail"] = value["href"][7:]
        elif kind == "text" and stack:
            stack[-1]["texts"].append(value)
        elif kind == "end" and tag in ("div", "li", "article") and stack:
            card = stack.pop()
            mail = card["mail"] or next((m[0] for t in card["texts"] if (m := EMAIL.search(t))), None)
            if mail and card["texts"] and not card["inner"]:
                out.append({"name": card["texts"][0], "title": card["texts"][1] if len(card["texts"]) > 1 else None, "email": mail})
    return out


def table_rows(html: str) -> list[list[str]]:
    """The cells of every table row."""
    rows: list[list[str]] = []
    for kind, tag, value, path in Reader(html).events:
        if kind == "start" and tag == "tr":
            rows.append([])
        elif kind == "start" and tag in ("td", "th") and rows:
            rows[-1].append("")
        elif kind == "text" and rows and rows[-1] and "tr" in path:
            rows[-1][-1] = f"{rows[-1][-1]} {value}".strip()
    return [r for r in rows if r]


def extract(pages: DataFrame, key: str, html: str, job: Callable[[str], list[dict]], schema: str) -> DataFrame:
    """(key, item_no, schema): what job makes of each page; a null page gives nothing."""
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = [(k, i, *(r.get(n) for n in names)) for k, h in zip(rows[key], rows[html], strict=True) if h for i, r in enumerate(job(h))]
            yield pd.DataFrame(out, columns=[key, "item_no", *names])

    return pages.select(key, html).mapInPandas(run, f"{key} {pages.schema[key].dataType.simpleString()}, item_no int, {schema}")


def outbound_links(pages: DataFrame, key: str, html: str, url: str, pattern: str = "^https?://") -> DataFrame:
    """(key, place, text, href): links in order, made absolute by the page's url, the first of each href kept, as far as
    they match; by expressions alone."""
    link = F.lit(r"(?is)<a\s[^>]*href=[\"']([^\"']+)[\"'][^>]*>(.*?)</a>")
    found = pages.select(key, url, F.posexplode(F.arrays_zip(F.regexp_extract_all(html, link, F.lit(1)).alias("href"), F.regexp_extract_all(html, link, F.lit(2)).alias("inner"))).alias("place", "a"))
    root = F.regexp_extract(url, "^(https?://[^/]+)", 1)
    scheme = F.regexp_extract(url, "^(https?:)", 1)
    href = F.when(F.col("a.href").startswith("//"), F.concat(scheme, F.col("a.href"))).when(F.col("a.href").startswith("/"), F.concat(root, F.col("a.href"))).otherwise(F.col("a.href"))
    text = F.trim(F.regexp_replace(F.regexp_replace("a.inner", "<[^>]*>", " "), r"\s+", " "))
    rows = found.select(key, "place", text.alias("text"), href.alias("href")).where(F.col("href").rlike(pattern))
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key, "href").orderBy("place"))).where("_n = 1").drop("_n")


def plan_rows(html: str) -> list[dict]:
    """(year, fall, spring) of a plan table: a row that names a year sets it for those below."""
    out, year = [], None
    for cells in table_rows(html):
        if re.search(r"(?i)\byear\b", cells[0]):
            year = cells[0]
        elif year and len(cells) >= 3:
            out.append({"year": year, "fall": cells[0], "spring": cells[2]})
    return out


def section_rows(html: str) -> list[dict]:
    """Class sections: a row of cells, and the row of notes after it, where the place follows the time."""
    out: list[dict] = []
    for cells in table_rows(html):
        if len(cells) >= 4:
            seats = cells[3]
            status = "full" if seats.lower() == "full" else "unopened" if "unopened" in seats.lower() else "open" if seats.isdigit() and int(seats) > 0 else "full" if seats == "0" else "unknown"
            out.append({"type": cells[0], "instructor": cells[1], "class_number": cells[2], "seats_status": status, "enrolled": None, "most": None, "days": None, "time": None, "location": None})
        elif out:
            note = " ".join(cells)
            n, when = re.search(r"(\d+) students? enrolled out of (\d+)", note), re.search(r"\b([MTWRFSU][A-Za-z]*)\s+(\d{1,2}:\d{2}\s*-\s*\d{1,2}:\d{2}\s*[AP]M)\s*(.*)", note)
            out[-1] |= {"enrolled": int(n[1]), "most": int(n[2])} if n else {}
            out[-1] |= {"days": when[1], "time": when[2], "location": when[3].strip() or None} if when else {}
    return out


def contacts(text: Column, buildings: str = r"[A-Z][a-z]+ (?:Hall|Building|Center)") -> Column:
    """(email, phone, room, building) of a text or page: the address of a mailto link before any other."""
    first = lambda p, i=0: F.nullif(F.regexp_extract(text, p, i), F.lit(""))
    room = rf"\b([0-9]{{2,4}}[A-Z]?) ({buildings})"
    email = F.coalesce(first(r"(?i)mailto:([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+)", 1), first(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"))
    return F.struct(email.alias("email"), first(r"[0-9]{3}-[0-9]{3}-[0-9]{4}").alias("phone"), first(room, 1).alias("room"), first(room, 2).alias("building"))


def outcome_items(text: Column, skip: Sequence[str] = ("learning outcomes", "will be able to", "back to", "home")) -> Column:
    """Items of a list of outcomes: bulleted lines of over twenty characters or, without any, lines of over fifteen that
    neither introduce the list nor lead elsewhere."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))  # F.trim itself would take the place as what to trim
    bulleted = F.filter(F.transform(F.filter(lines, lambda x: x.rlike("^[-*\u2022] ")), lambda x: F.trim(F.substring(x, 2, 1_000_000))), lambda x: F.length(x) > 20)
    plain = F.filter(lines, lambda x: (F.length(x) > 15) & ~F.greatest(*[F.lower(x).contains(w) for w in skip], F.lit(False)))
    return F.when(F.size(bulleted) > 0, bulleted).otherwise(plain)
