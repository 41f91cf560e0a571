"""A judge's flat answers about a galaxy: strict parse, path of nodes, answer per question."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from asterfold.functions.binding import bound

#: Field, question, the field and answers on which the question hangs, its answers.
FIELDS = (
    ("overall_shape", "smooth-or-featured", None, (), ("smooth", "featured-or-disk", "artifact")),
    ("roundness", "how-rounded", "overall_shape", ("smooth",), ("round", "in-between", "cigar-shaped")),
    ("edge_on", "disk-edge-on", "overall_shape", ("featured-or-disk",), ("edge-on-yes", "edge-on-no")),
    ("edge_on_bulge", "edge-on-bulge", "edge_on", ("edge-on-yes",), ("boxy", "none", "rounded")),
    ("has_spiral_arms", "has-spiral-arms", "edge_on", ("edge-on-no",), ("has-spiral-arms-yes", "has-spiral-arms-no")),
    ("spiral_winding", "spiral-winding", "has_spiral_arms", ("has-spiral-arms-yes",), ("tight", "medium", "loose")),
    ("spiral_arm_count", "spiral-arm-count", "has_spiral_arms", ("has-spiral-arms-yes",), ("1", "2", "3", "4", "more-than-4", "cant-tell")),
    ("bar", "bar", "edge_on", ("edge-on-no",), ("strong", "weak", "no")),
    ("bulge_size", "bulge-size", "edge_on", ("edge-on-no",), ("dominant", "large", "moderate", "small", "none")),
    ("merging", "merging", "overall_shape", ("smooth", "featured-or-disk"), ("none", "minor-disturbance", "major-disturbance", "merger")),
)
SILENT = "not-mentioned"


#: Where the nested form keeps a field, and which fields an object may have, by the answer that it hangs on.
PLACES = {
    "overall_shape": "classification", "roundness": "classification", "merging": "classification", "edge_on": "classification.orientation",
    "edge_on_bulge": "classification.orientation", "bar": "classification.orientation", "bulge_size": "classification.orientation",
    "has_spiral_arms": "classification.orientation.spiral_arms", "spiral_winding": "classification.orientation.spiral_arms", "spiral_arm_count": "classification.orientation.spiral_arms",
}
OBJECTS = (
    ("classification", "overall_shape", {"smooth": ("overall_shape", "roundness", "merging"), "featured-or-disk": ("overall_shape", "orientation", "merging"), "artifact": ("overall_shape",)}),
    ("classification.orientation", "edge_on", {"edge-on-yes": ("edge_on", "edge_on_bulge"), "edge-on-no": ("edge_on", "spiral_arms", "bar", "bulge_size"), SILENT: ("edge_on",)}),
    ("classification.orientation.spiral_arms", "has_spiral_arms", {
        "has-spiral-arms-yes": ("has_spiral_arms", "spiral_winding", "spiral_arm_count"), "has-spiral-arms-no": ("has_spiral_arms",), SILENT: ("has_spiral_arms",)}),
)


def parsed(response: Column) -> Column:
    return F.from_json(F.trim(response), ", ".join(f"{f[0]} string" for f in FIELDS))


def _document(response: Column) -> Column:
    """The response as a variant within an array of one; null if it isn't one JSON object and nothing else."""
    text = F.trim(response)
    one = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))  # text behind the object makes this no array of one
    return F.when(text.startswith("{") & F.try_variant_get(one, "$[1]", "variant").isNull(), one)


def _kind(document: Column, place: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(document, f"$[0].{place}", "variant"))


def _value(document: Column, place: str) -> Column:
    return F.try_variant_get(document, f"$[0].{place}", "string")


def fault(response: Column) -> Column:
    """Why a response breaks the flat schema: no_json, or the fields with answers outside their lists; null for a good one.

    The response must be one JSON object with nothing behind it; an answer must be a string (null for all but the
    first field), so a number is no answer.
    """

    def checked(document: Column) -> Column:
        wrong = []
        for field, _, parent, _, answers in FIELDS:
            kind, allowed = _kind(document, field), answers if parent is None else (*answers, SILENT)
            bad = (kind != "STRING") | ~_value(document, field).isin(*allowed)
            silent = kind.isNull() | (kind == "VOID")
            wrong.append(F.when(F.when(silent, F.lit(parent is None)).otherwise(bad), field))
        return F.when(document.isNull(), "no_json").otherwise(F.nullif(F.concat_ws(";", *wrong), F.lit("")))

    return bound(_document(response), checked)


def nested(response: Column) -> Column:
    """The flat fields of a response in the nested form."""
    return bound(_document(response), lambda d: F.struct(*[_value(d, f"{PLACES[f[0]]}.{f[0]}").alias(f[0]) for f in FIELDS]))


def nested_fault(response: Column) -> Column:
    """Why a response breaks the nested schema, null for a good one: no_json, or its objects and fields that do.

    Each object must have exactly the keys that the answer which it hangs on asks for, and each field a listed string.
    """

    def checked(document: Column) -> Column:
        text = F.trim(response)
        wrong = [F.when(~F.coalesce(F.json_object_keys(text) == F.array(F.lit("classification")), F.lit(False)), "keys")]
        used = F.lit(True)
        for place, decides, by_answer in OBJECTS:
            keys, answer = F.array_sort(F.json_object_keys(F.get_json_object(text, f"$.{place}"))), _value(document, f"{place}.{decides}")
            fits = F.lit(False)
            for value, wanted in by_answer.items():
                fits = fits | ((answer == value) & (keys == F.array(*map(F.lit, sorted(wanted)))))
            wrong.append(F.when(used & ~F.coalesce(fits, F.lit(False)), place.rpartition(".")[2]))
            for field in (f for f, at in PLACES.items() if at == place):
                kind, allowed = _kind(document, f"{place}.{field}"), next((*f[4], SILENT) if f[2] else f[4] for f in FIELDS if f[0] == field)
                wrong.append(F.when(used & kind.isNotNull() & ~F.coalesce((kind == "STRING") & _value(document, f"{place}.{field}").isin(*allowed), F.lit(False)), field))
            used = used & F.coalesce(answer == {"overall_shape": "featured-or-disk", "edge_on": "edge-on-no"}.get(decides, ""), F.lit(False))
        return F.when(document.isNull(), "no_json").otherwise(F.nullif(F.concat_ws(";", *wrong), F.lit("")))

    return bound(_document(response), checked)


def _reached(tree: Column) -> dict[str, Column]:
    """For each field whether the answers above it lead to it."""
    out: dict[str, Column] = {}
    for field, _, parent, answers, _ in FIELDS:
        out[field] = F.lit(True) if parent is None else out[parent] & F.coalesce(tree[parent].isin(*answers), F.lit(False))
    return out


def _short(value: Column) -> Column:
    return F.regexp_replace(value, "^(edge-on|has-spiral-arms)-", "")


def path(tree: Column) -> Column:
    """The nodes question_answer (question-not-mentioned) of the questions that the answers lead to, in order."""
    reached, nodes = _reached(tree), []
    for field, question, *_ in FIELDS:
        name = F.when(tree[field] == SILENT, f"{question}-{SILENT}").otherwise(F.concat(F.lit(f"{question}_"), _short(tree[field])))
        nodes.append(F.when(reached[field], name))
    return F.filter(F.array(*nodes), lambda n: n.isNotNull())


def answers(tree: Column) -> Column:
    """question -> answer: not-stated where silent, not-applicable where the answers above don't lead to it."""
    reached, pairs = _reached(tree), []
    for field, question, *_ in FIELDS:
        said = F.when(tree[field].isNull() | (tree[field] == SILENT), "not-stated").otherwise(_short(tree[field]))
        pairs += [F.lit(question), F.when(reached[field], said).otherwise("not-applicable")]
    return F.create_map(*pairs)
