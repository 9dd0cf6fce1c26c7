"""S16: annotation schema files. They are small by nature, so they are read on the driver into rule lists."""

import pathlib
import re
from dataclasses import dataclass, field

# Section names and their aliases, wildcards, reserved keys, special relation types.
SECTIONS = ["entities", "relations", "events", "attributes"]
SECTION_ALIAS = {"spans": "entities"}
ANY, ENTITY, EVENT, RELATION = "<ANY>", "<ENTITY>", "<EVENT>", "<RELATION>"
OVERLAP, NESTING = "<OVERLAP>", "ENTITY-NESTING"
RESERVED_KEYS = ["<REL-TYPE>", "<OVL-TYPE>", "<NORM>", "<GLYPH-POS>", "<DEFAULT>"]
RESERVED_NAMES = [ANY, ENTITY, EVENT, RELATION, OVERLAP, *RESERVED_KEYS]
UNLIMITED = 2147483647
REPEATS = {"": (1, 1), "?": (0, 1), "*": (0, UNLIMITED), "+": (1, UNLIMITED)}


class SchemaError(ValueError):
    pass


@dataclass
class Schema:
    """Rule lists; :meth:`frame` gives one as a DataFrame."""

    types: list = field(default_factory=list)  # (section, type, parent, unused, depth)
    arg_rules: list = field(default_factory=list)  # (type, role, target_type, min_count, max_count)
    relation_rules: list = field(default_factory=list)  # (type, role1, type1, role2, type2, symmetric, transitive)
    attribute_rules: list = field(default_factory=list)  # (attr, target_type)
    overlap_rules: list = field(default_factory=list)  # (inner, outer, kind)

    DDL = {
        "types": "section string, type string, parent string, unused boolean, depth int",
        "arg_rules": "type string, role string, target_type string, min_count int, max_count int",
        "relation_rules": "type string, arg1_role string, arg1_type string, arg2_role string, arg2_type string, "
        "symmetric boolean, transitive boolean",
        "attribute_rules": "attr string, target_type string",
        "overlap_rules": "inner string, outer string, kind string",
    }

    def frame(self, spark, name):
        return spark.createDataFrame(getattr(self, name), self.DDL[name])

    def types_in(self, section):
        return list(dict.fromkeys(t[1] for t in self.types if t[0] == section))

    @property
    def entity_types(self):
        return self.types_in("entities")

    @property
    def event_types(self):
        return self.types_in("events")

    @property
    def relation_types(self):
        return self.types_in("relations")

    @property
    def equiv_types(self):
        return list(dict.fromkeys(r[0] for r in self.relation_rules if r[5] and r[6]))

    def members(self, wildcard):
        """Types a rule's type stands for; ANY also stays as itself, so that unknown types meet it."""
        groups = {
            ANY: [*self.entity_types, *self.event_types, ANY],
            ENTITY: self.entity_types,
            EVENT: self.event_types,
            RELATION: self.relation_types,
        }
        return groups.get(wildcard, [wildcard])


def _count(text):
    """(role, least, most) of a role as written: its name and how often it may stand."""
    name, brace, inside = text.partition("{")
    if not brace:
        name = text.rstrip("?*+")
        sign = text[len(name) :]
        if sign not in REPEATS:
            raise SchemaError(f"bad repetition {sign!r}")
        return name, *REPEATS[sign]
    bounds = inside.removesuffix("}").split("-")
    if not inside.endswith("}") or len(bounds) > 2 or not all(b.isdigit() for b in bounds):
        raise SchemaError(f"bad repetition {brace + inside!r}")
    least, most = int(bounds[0]), int(bounds[-1])
    if least > most or most == 0:
        raise SchemaError(f"bad repetition range {brace + inside!r}")
    return name, least, most


class _Entry:
    """One line of a section: a type with its other names, and its arguments."""

    def __init__(self, line, section):
        body = line.lstrip()
        self.depth = len(line) - len(body)
        head, _, tail = body.partition("\t")
        # Names may hold single blanks if a tab ends them; else the first white space does.
        if section != "attributes" and ("\t" not in body or " " not in head.strip() or "  " in head):
            head, tail = (body.split(None, 1) + [""])[:2]
        names = [n.strip() for n in head.split("|") if n.strip()]
        self.unused = any(n[0] == "!" for n in names)
        first = names[0].lstrip("!")
        plain = "".join(c if c.isascii() and (c.isalnum() or c in "_-") else "_" for c in first)
        self.name = first if first in (OVERLAP, NESTING) else plain
        self.roles, self.special = {}, {}
        for part in filter(None, map(str.strip, tail.split(","))):
            self._add(part)

    def _add(self, part):
        key, colon, value = part.partition(":")
        if not colon or len(part.split()) != 1:
            raise SchemaError(f"bad argument {part!r}")
        if key in RESERVED_KEYS:
            self.special[key] = value
            return
        role, least, most = _count(key)
        types = value.split("|")
        if not role or role in self.roles or not all(types):
            raise SchemaError(f"bad argument {part!r}")
        if most > 1 and role[-1].isdigit():
            raise SchemaError(f"a role that ends with a digit cannot repeat: {part!r}")
        self.roles[role] = (types, least, most)


def _expanded(line, macros):
    """The line with macros in place; any other name in angle brackets must be a reserved one."""
    def value(found):
        name = found[0]
        if name not in macros and name not in RESERVED_NAMES:
            raise SchemaError(f"undefined macro {name}")
        return macros.get(name, name)

    return re.sub("<[^<>]*>", value, line)


def _nodes(lines, section):
    """(type, parent, unused, depth, roles, special) per line of a section; the indent gives the parent."""
    macros, above = {}, []
    for line in lines:
        shown = line.strip()
        if not shown or shown[0] == "#" or set(shown) == {"-"}:
            continue
        name, defines, value = line.partition(">=")
        if defines and line[0] == "<" and name[1:].replace("-", "").replace("_", "").isalpha():
            if f"{name}>" in RESERVED_NAMES:
                raise SchemaError(f"{name}> is a reserved name")
            macros[f"{name}>"] = _expanded(value.strip(), macros)
            continue
        entry = _Entry(_expanded(line, macros), section)
        if entry.depth > len(above):
            raise SchemaError(f"no parent for {entry.name!r}")
        above = [*above[: entry.depth], entry.name]
        parent = above[-2] if entry.depth else None
        yield entry.name, parent, entry.unused, entry.depth, entry.roles, entry.special


def parse_schema(text) -> Schema:
    sections, current = {s: [] for s in SECTIONS}, None
    for line in text.split("\n"):
        m = re.match(r"^\s*\[(.*)\]\s*$", line)
        if m:
            current = SECTION_ALIAS.get(m.group(1), m.group(1))
        elif current in sections:
            sections[current].append(line)
    nodes = {s: list(_nodes(lines, s)) for s, lines in sections.items()}
    schema = Schema()
    for section in SECTIONS:
        for name, parent, unused, depth, _, _ in nodes[section]:
            if name not in (OVERLAP, NESTING):
                schema.types.append((section, name, parent, unused, depth))

    overlaps, nestings = [], []
    for name, _, _, _, roles, special in nodes["relations"]:
        if len(roles) != 2:
            continue
        (role1, (types1, _, _)), (role2, (types2, _, _)) = roles.items()
        pairs = [(a, b) for x in types1 for a in schema.members(x) for y in types2 for b in schema.members(y)]
        if name == OVERLAP:
            overlaps += [(a, b, k) for a, b in pairs for k in special.get("<OVL-TYPE>", "").split("|") if k]
        elif name == NESTING:
            nestings += [(a, b, "contain") for a, b in pairs]
        else:
            kinds = special["<REL-TYPE>"].split("-") if "<REL-TYPE>" in special else []
            if name == "Equiv" and not kinds:
                kinds = ["symmetric", "transitive"]
            flags = ("symmetric" in kinds, "transitive" in kinds)
            schema.relation_rules += [(name, role1, a, role2, b, *flags) for a, b in pairs]
    given = {(a, b) for a, b, _ in overlaps}
    schema.overlap_rules = list(dict.fromkeys(overlaps + [n for n in nestings if n[:2] not in given]))
    for section in ("entities", "events"):
        for name, _, _, _, roles, _ in nodes[section]:
            for role, (names, low, high) in roles.items():
                schema.arg_rules += [(name, role, t, low, high) for x in names for t in schema.members(x)]
    for name, _, _, _, roles, _ in nodes["attributes"]:
        if "Arg" in roles:
            schema.attribute_rules += [(name, t) for x in roles["Arg"][0] for t in schema.members(x)]
    for rules in ("relation_rules", "arg_rules", "attribute_rules"):
        setattr(schema, rules, list(dict.fromkeys(getattr(schema, rules))))
    return schema


def load_schema(directory, filename="annotation.conf", top=None) -> Schema:
    """Schema from the nearest folder at or above ``directory`` that has the file, up to ``top``."""
    folder = pathlib.Path(directory).resolve()
    top = pathlib.Path(top).resolve() if top else pathlib.Path(folder.anchor)
    for place in [folder, *folder.parents]:
        if (place / filename).is_file():
            return parse_schema((place / filename).read_text(encoding="utf-8"))
        if place == top:
            break
    raise FileNotFoundError(f"no {filename} at or above {directory}")


# V21
def connection_matrix(spark, schema: Schema):
    """(from_type, via, to_type): every allowed connection; a name that is both relation and role counts once."""
    rows = []
    known = [*schema.entity_types, *schema.event_types]
    for t1 in dict.fromkeys(known):
        via = {}
        for r in schema.relation_rules:
            if r[2] in (t1, ANY) and r[4] != ANY:
                via.setdefault(r[0], []).append(r[4])
        relations = set(via)
        for name, role, target, _, _ in schema.arg_rules:
            if name == t1 and role not in relations and target != ANY:
                via.setdefault(role, []).append(target)
        rows += [(t1, name, t2) for name, targets in via.items() for t2 in dict.fromkeys(targets)]
    return spark.createDataFrame(rows, "from_type string, via string, to_type string")
