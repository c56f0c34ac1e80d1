"""Column functions of the catalogue. All are built-in expressions; nulls give nulls unless said otherwise."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# File extensions by kind of media.
GIF, VIDEO = ["gif"], ["mp4", "webm", "mkv", "mov", "avi", "m4v"]
# Names of generation settings, and the names they are kept under.
SETTINGS = {
    "steps": "steps", "sampler": "sampler", "schedule type": "scheduler", "scheduler": "scheduler", "cfg scale": "cfg_scale", "seed": "seed", "size": "size", "model": "model", "model hash": "model_hash", "vae": "vae",
    "vae hash": "vae_hash", "clip skip": "clip_skip", "denoising strength": "denoising", "hires upscaler": "hires_upscaler", "hires steps": "hires_steps", "hires upscale": "hires_upscale", "hires resize": "hires_resize",
    "hires cfg scale": "hires_cfg", "hires checkpoint": "hires_checkpoint", "hires sampler": "hires_sampler",
}
# Metadata entries that are not searched.
UNSEARCHED = ["negative_prompt", "error", "raw_parameters", "comfyui_prompt", "comfyui_workflow", "file_size", "video_meta_error", "duration", "width_px", "height_px", "major_brand", "minor_version", "compatible_brands", "encoder", "handler_name", "vendor_id"]
# Graph nodes that load a model, with the input that names its file, those that load an adapter, and model file endings.
MODEL_LOADERS = {"CheckpointLoaderSimple": "ckpt_name", "CheckpointLoader": "ckpt_name", "unCLIPCheckpointLoader": "ckpt_name", "UNETLoader": "unet_name"}
ADAPTER_LOADERS = ["LoraLoader", "LoraLoaderModelOnly"]
MODEL_ENDINGS = "safetensors|ckpt|pt|pth|bin|gguf"
# The counter at the end of a copy's name, and what counts as punctuation and as a bare number in search texts.
COUNTER = "[\\s_]*\\(\\d+\\)$"
PUNCTUATION = "[(){}\\[\\]:,.<>|/\\\\!?;\"'+*~`^=_]"
BARE_NUMBER = "\\b\\d+\\.?\\d*\\b"


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once for the row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "\\s+", " "))


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, "^\\s+|\\s+$", "")


def _or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def norm_tag(c: Column) -> Column:
    """F1. Lower case, underscores as spaces, white space single and trimmed; null gives ''."""
    return _squeeze(F.translate(F.lower(_or_empty(c)), "_", " "))


def name_base(c: Column) -> Column:
    """F2. A file name without its extension and a trailing counter like `` (3)``; a bare counter stays."""
    stem = F.regexp_replace(_or_empty(c), "(?s)^(.*)\\.[^.]*$", "$1")
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(stem, COUNTER, "")), F.lit("")), stem)


def norm_base(c: Column) -> Column:
    """F3. The normal form of the name base."""
    return norm_tag(name_base(c))


def natural_key(c: Column) -> Column:
    """F4. Lower case with every run of fewer than ten digits padded to ten, so that names sort by number."""
    low = F.lower(_or_empty(c))
    padded = F.regexp_replace(low, "(?<!\\d)(\\d{1,9})(?!\\d)", "\u0001000000000$1")
    return F.regexp_replace(padded, "\u0001\\d*?(\\d{10})(?!\\d)", "$1")


def clean_search_text(c: Column) -> Column:
    """F5. Lower case, punctuation as spaces, bare numbers dropped, white space single."""
    return _squeeze(F.regexp_replace(F.regexp_replace(F.lower(_or_empty(c)), PUNCTUATION, " "), BARE_NUMBER, " "))


def search_document(meta: Column) -> Column:
    """F6. The values of a metadata map that may be searched, in key order, cleaned."""
    wanted = F.map_filter(meta, lambda k, v: ~k.isin(UNSEARCHED) & v.isNotNull() & (F.trim(v) != ""))
    keys = F.array_sort(F.map_keys(wanted))
    return clean_search_text(F.array_join(F.transform(keys, lambda k: F.trim(F.element_at(wanted, k))), " "))


def _first_spellings(words: Column) -> Column:
    low = F.transform(words, lambda w: F.lower(w))
    return F.filter(F.transform(words, lambda w, i: F.when(F.array_position(low, F.lower(w)) == i + 1, w)), lambda w: w.isNotNull())


def split_keywords(c: Column, longest: int | None = 100) -> Column:
    """F7. Keywords of a ``;`` or ``,`` list: white space single, those over ``longest`` characters dropped (None: none), first spelling kept."""
    words = F.transform(F.split(_or_empty(c), "[;,]"), _squeeze)
    return _let(F.filter(words, lambda w: (w != "") if longest is None else (w != "") & (F.length(w) <= longest)), _first_spellings)


def merge_keywords(a: Column, b: Column) -> Column:
    """F8. The keywords of ``a`` and then those of ``b`` that are new, joined by ``, ``."""
    return F.array_join(_let(F.concat(split_keywords(a), split_keywords(b)), _first_spellings), ", ")


def merge_maps(own: Column, extra: Column) -> Column:
    """F9. ``own`` with the entries of ``extra`` whose keys it lacks."""
    own, extra = (F.coalesce(m, F.create_map().cast("map<string,string>")) for m in (own, extra))
    return F.map_concat(own, F.map_filter(extra, lambda k, v: ~F.map_contains_key(own, k)))


def display_tag(c: Column) -> Column:
    """F10. Underscores as spaces."""
    return F.translate(_or_empty(c), "_", " ")


def display_name(c: Column) -> Column:
    """F10. As display_tag, each word (by white space) with a capital."""
    return F.initcap(display_tag(c))


def extension(c: Column) -> Column:
    return F.lower(F.regexp_extract(_or_empty(c), "\\.([^.\\\\/]+)$", 1))


def media_type(c: Column) -> Column:
    """F11. image, gif or video by file extension."""
    return F.when(extension(c).isin(GIF), "gif").when(extension(c).isin(VIDEO), "video").otherwise("image")


def safe_filename(c: Column) -> Column:
    """F12. The last path segment without drive, forbidden and control characters, outer dots and spaces; else ``dropped``."""
    leaf = F.trim(F.element_at(F.split(F.translate(_or_empty(c), "\\", "/"), "/"), -1))
    leaf = F.element_at(F.split(leaf, ":"), -1)
    leaf = F.regexp_replace(F.regexp_replace(leaf, "[<>:\"|?*\\x00-\\x1f]", ""), "^[. ]+|[. ]+$", "")
    return F.coalesce(F.nullif(leaf, F.lit("")), F.lit("dropped"))


def segments(c: Column) -> Column:
    return F.filter(F.split(_or_empty(c), "[\\\\/]"), lambda s: s != "")


def path_leaf(c: Column) -> Column:
    """F15. The last segment, either separator; '' if none."""
    return F.coalesce(F.try_element_at(segments(c), F.lit(-1)), F.lit(""))


def path_parent(c: Column) -> Column:
    """F15. What stands before the last separator; '' if there is none."""
    return F.regexp_replace(_or_empty(c), "[\\\\/]?[^\\\\/]*$", "")


def path_ancestors(c: Column) -> Column:
    """F15. Every prefix of a path, itself last, joined by ``/``; empty for an empty path."""
    parts = segments(c)
    return F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).otherwise(F.array().cast("array<string>"))


def display_folder(path: Column, root: Column) -> Column:
    """F13. The folder of ``path`` as ``<root's name>\\<rest>``; null outside ``root``."""
    folder = F.translate(path_parent(path), "\\", "/")
    base = F.regexp_replace(F.translate(root, "\\", "/"), "/+$", "")
    rest = F.substr(folder, F.length(base) + 2)
    shown = F.when(folder == base, path_leaf(base)).when(folder.startswith(F.concat(base, F.lit("/"))), F.concat(path_leaf(base), F.lit("\\"), F.translate(rest, "/", "\\")))
    return shown


def resolve_folder(folders: DataFrame, roots: DataFrame) -> DataFrame:
    """F14. ``folders(folder)`` with the ``path`` below the root of the same name in ``roots(path)``; null if none fits."""
    want = F.regexp_replace(F.translate(F.col("folder"), "\\", "/"), "^/+|/+$", "")
    named = roots.select(F.col("path").alias("root"), path_leaf(F.col("path")).alias("name")).groupBy("name").agg(F.min("root").alias("root"))
    asked = folders.withColumn("__want", want).withColumn("name", F.substring_index("__want", "/", 1))
    rest = F.substr(F.col("__want"), F.length("name") + 1)
    return asked.join(named, "name", "left").select(*folders.columns, F.concat("root", rest).alias("path"))


def hamming_pct(dist: Column, bits: int = 256) -> Column:
    """F16. 100 for distance 0 only; else rounded down, 0 to 99."""
    share = F.floor((1 - dist / F.lit(bits)) * 100)
    return F.when(dist <= 0, 100).otherwise(F.greatest(F.lit(0), F.least(F.lit(99), share))).cast("int")


def hamming(a: Column, b: Column) -> Column:
    """F17. Unlike bits of two arrays of packed words."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def pack_hex(c: Column, bits: int = 256) -> Column:
    """F18. A hex string as 32-bit words, padded on the left; null if it is no hex or too long."""
    digits = bits // 4
    full = F.lpad(c, digits, "0")
    words = F.transform(F.sequence(F.lit(0), F.lit(digits // 8 - 1)), lambda i: F.conv(F.substr(full, i * 8 + 1, F.lit(8)), 16, 10).cast("long"))
    return F.when(c.rlike(f"^[0-9a-fA-F]{{1,{digits}}}$"), words)


def aspect_ratio(w: Column, h: Column) -> Column:
    """F19. Width by height; 0 when either is unknown."""
    return F.when((F.coalesce(w, F.lit(0)) > 0) & (F.coalesce(h, F.lit(0)) > 0), w / h).otherwise(F.lit(0.0))


def oriented_size(w: Column, h: Column, orientation: Column) -> Column:
    """F20. (width, height), swapped for orientations 5 to 8."""
    turned = orientation.between(5, 8)
    return F.struct(F.when(turned, h).otherwise(w).alias("width"), F.when(turned, w).otherwise(h).alias("height"))


def file_date(*dates: Column) -> Column:
    """F21. The oldest date that is known (not null, not 0); 0.0 if none."""
    known = [F.when(d != 0, d.cast("double")) for d in dates]
    return F.coalesce(F.least(*known) if len(known) > 1 else known[0], F.lit(0.0))


def content_key(version: Column, path: Column, mtime: Column) -> Column:
    """F22. Eight hex digits that change with version, path or date."""
    return F.substring(F.md5(F.concat_ws(":", version, path, mtime.cast("string"))), 1, 8)


def _unique_entries(entries: Column, last: bool) -> Column:
    """Struct array (k, v) with one entry a key: the last, or the first."""
    keys = F.transform(entries, lambda e: e["k"])

    def own(e: Column, i: Column) -> Column:
        at = F.array_position(F.reverse(keys), e["k"]) if last else F.array_position(keys, e["k"])
        return F.when((F.size(keys) - at == i) if last else (at == i + 1), e)

    return F.filter(F.transform(entries, own), lambda e: e.isNotNull())


#: An entry of the settings line: a name, a colon, and a quoted value or what goes up to the comma.
_ENTRY = '[^:,]*:\\s*(?:"(?:[^"\\\\]|\\\\.)*+"\\s*(?=,|$)|[^,]*)'
#: What a name may be made of; anything before it belongs to no entry.
_NAME = "[\\w \\-/()]+$"


def _cut(c: Column, most: int | None) -> Column:
    return c if most is None else F.substring(c, 1, most)


def _settings(tail: Column, most: int | None) -> Column:
    """The entries of a settings line as (k, v, known), empty ones left out."""
    names = F.create_map(*[F.lit(x) for kv in SETTINGS.items() for x in kv])

    def entry(text: Column) -> Column:
        colon = F.instr(text, ":")
        low = F.lower(_strip(F.regexp_extract(F.substr(text, F.lit(1), colon - 1), _NAME, 0)))
        value = _strip(F.substr(text, colon + 1))
        bare = F.when(value.rlike('(?s)^".*"$') & (F.length(value) >= 2), F.regexp_replace(F.substr(value, F.lit(2), F.length(value) - 2), "\\\\([\\\\\"])", "$1")).otherwise(value)
        known = F.element_at(names, low)
        plain = F.regexp_replace(F.regexp_replace(low, "[^a-z0-9]+", "_"), "^_+|_+$", "")
        return F.struct(F.coalesce(known, plain).alias("k"), _cut(bare, most).alias("v"), known.isNotNull().alias("known"))

    return F.filter(F.transform(F.regexp_extract_all(tail, F.lit(_ENTRY), 0), entry), lambda e: (e["k"] != "") & (e["v"] != ""))


def _prompts(head: Column, most: int | None, most_negative: int | None) -> Column:
    """The prompt and what is not wanted, as entries, in what stands before the settings."""

    def split(at: Column) -> Column:
        prompt = _strip(F.when(at > 0, F.substr(head, F.lit(1), at - 1)).otherwise(head))
        negative = F.when(at > 0, _strip(F.regexp_replace(F.substr(head, at), "^Negative prompt:\\s*", "")))
        each = [F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in (("prompt", _cut(prompt, most)), ("negative_prompt", _cut(negative, most_negative)))]
        return F.filter(F.array(*each), lambda e: e["v"].isNotNull() & (e["v"] != ""))

    return _let(F.regexp_instr(head, F.lit("\\bNegative prompt:\\s*")), split)


def _with_final_size(m: Column) -> Column:
    """The map with ``hires_size``: the size resized to, or the size times the factor."""
    of = lambda k: F.try_element_at(m, F.lit(k))
    side = lambda i: F.regexp_extract(of("size"), "^(\\d+)\\s*x\\s*(\\d+)", i).try_cast("int")
    factor = of("hires_upscale").try_cast("double")
    times = lambda x: F.bround(x * factor).cast("int").cast("string")
    resized = F.nullif(F.regexp_replace(F.regexp_extract(of("hires_resize"), "^(\\d+)\\s*x\\s*(\\d+)", 0), "\\s*x\\s*", "x"), F.lit(""))
    made = F.when(F.map_contains_key(m, "hires_size"), None).when(F.map_contains_key(m, "hires_resize"), resized).otherwise(F.concat(times(side(1)), F.lit("x"), times(side(2))))
    return _let(made, lambda v: F.when(v.isNotNull(), F.map_concat(m, F.create_map(F.lit("hires_size"), v))).otherwise(m))


def parse_infotext(c: Column, most_prompt: int | None = 2000, most_negative: int | None = 1000, most_value: int | None = 300) -> Column:
    """F23. Generation settings of an image as a map: prompt, negative_prompt and each ``Key: Value`` of the tail.

    Known keys take their canonical name and the last value; unknown ones a
    plain name and the first. ``hires_size`` is derived. Values are cut at so
    many characters, not at all for None. Null gives an empty map. Each step
    is worked out once for a text.
    """

    def parts(text: Column) -> Column:
        def at(cut: Column) -> Column:
            head = F.when(cut > 0, F.regexp_replace(F.substr(text, F.lit(1), cut - 1), "[\\s,]+$", "")).otherwise(text)
            tail = F.when(cut > 0, F.regexp_replace(F.substr(text, cut), "\\s*\\n\\s*", ", ")).otherwise("")
            return F.struct(head.alias("head"), tail.alias("tail"))

        return _let(F.regexp_instr(text, F.lit("\\bSteps:\\s*\\d")), at)

    plain = lambda part: F.transform(part, lambda e: F.struct(e["k"].alias("k"), e["v"].alias("v")))

    def entries(p: Column) -> Column:
        def merged(found: Column) -> Column:
            known = _let(plain(F.filter(found, lambda e: e["known"])), lambda x: _unique_entries(x, True))
            free = _let(plain(F.filter(found, lambda e: ~e["known"])), lambda x: _unique_entries(x, False))
            return F.concat(_prompts(p["head"], most_prompt, most_negative), known, free)

        # Canonical names first: a free name that equals one of them is not new.
        return _let(_let(_settings(p["tail"], most_value), merged), lambda x: F.map_from_entries(_unique_entries(x, False)))

    text = _strip(F.translate(_or_empty(c), "\u0000", ""))
    return _let(_let(_let(text, parts), entries), _with_final_size)


_GRAPH = "map<string,struct<class_type:string,inputs:map<string,string>>>"


def _model_name(c: Column) -> Column:
    leaf = _strip(F.element_at(F.split(F.translate(c, "\\", "/"), "/"), -1))
    return F.when(~c.startswith("["), F.regexp_replace(leaf, f"(?i)\\.({MODEL_ENDINGS})$", ""))


def _strength(c: Column) -> Column:
    return F.regexp_replace(F.format_string("%s", c.try_cast("double")), "\\.0$", "")


def parse_node_graph(c: Column, most_prompt: int | None = 2000, most_models: int | None = 300, most_loras: int | None = 1000) -> Column:
    """F24. (prompt, models, loras) of a node graph in JSON, cut at so many characters (None: not at all); nulls where there is nothing.

    Texts of wildcard nodes go before those of plain text nodes; an input that
    is a link to another node (a JSON array) counts as absent.
    """
    nodes = F.map_values(F.from_json(c, _GRAPH))
    inputs = lambda n, k: F.try_element_at(n["inputs"], F.lit(k))
    text = lambda kind, key: F.array_distinct(F.filter(F.transform(F.filter(nodes, kind), lambda n: _strip(inputs(n, key))), lambda t: t.isNotNull() & (t != "") & ~t.rlike("(?s)^\\[.*\\]$")))
    wild = text(lambda n: n["class_type"].contains("Wildcard"), "populated_text")
    plain = text(lambda n: n["class_type"] == "CLIPTextEncode", "text")
    texts = F.when(F.size(wild) > 0, wild).otherwise(plain)
    loads = F.create_map(*[F.lit(x) for kv in MODEL_LOADERS.items() for x in kv])
    models = F.transform(F.filter(nodes, lambda n: n["class_type"].isin(list(MODEL_LOADERS))), lambda n: _model_name(F.try_element_at(n["inputs"], F.element_at(loads, n["class_type"]))))
    models = F.array_distinct(F.filter(models, lambda m: m.isNotNull() & (m != "")))

    def adapter(n: Column) -> Column:
        name, sm, sc = _model_name(inputs(n, "lora_name")), _strength(inputs(n, "strength_model")), _strength(inputs(n, "strength_clip"))
        sm, sc = (F.nullif(s, F.lit("null")) for s in (sm, sc))
        both = F.when(sc.isNull() | (sc == sm), sm).otherwise(F.concat(F.lit("model "), F.coalesce(sm, F.lit("?")), F.lit(", clip "), sc))
        return F.when(both.isNotNull(), F.concat(name, F.lit(" ("), both, F.lit(")"))).otherwise(name)

    loras = F.array_distinct(F.filter(F.transform(F.filter(nodes, lambda n: n["class_type"].isin(ADAPTER_LOADERS)), adapter), lambda m: m.isNotNull() & (m != "")))
    joined = lambda a, by, most: F.nullif(_cut(F.array_join(a, by), most), F.lit(""))
    return F.struct(joined(texts, "\n", most_prompt).alias("prompt"), joined(models, ", ", most_models).alias("models"), joined(loras, "\n", most_loras).alias("loras"))


def gps_decimal(lat: Column, lat_ref: Column, lon: Column, lon_ref: Column) -> Column:
    """F25. Degrees, minutes and seconds as ``lat, lon`` with six decimals; south and west are negative."""
    value = lambda d: d[0] + d[1] / 60.0 + d[2] / 3600.0
    la = value(lat) * F.when(lat_ref == "S", -1.0).otherwise(1.0)
    lo = value(lon) * F.when(lon_ref == "W", -1.0).otherwise(1.0)
    return F.when((F.size(lat) >= 3) & (F.size(lon) >= 3), F.format_string("%.6f, %.6f", la, lo))


def normalize_keys(meta: Column, longest: int | None = 500) -> Column:
    """F26. ``Group:CamelKey`` entries as ``camel_key``: tool groups and values over ``longest`` characters (None: no values) go; the first wins."""
    kept = F.filter(F.map_entries(meta), lambda e: e["key"].contains(":") & ~F.split(e["key"], ":")[0].isin("ExifTool", "System", "File") & (F.lit(True) if longest is None else F.length(e["value"]) <= longest) & ~e["value"].startswith("(Binary"))
    plain = F.transform(kept, lambda e: F.struct(F.lower(F.regexp_replace(F.regexp_extract(e["key"], "^[^:]*:(.*)$", 1), "(?<!^)(?=[A-Z])", "_")).alias("k"), e["value"].alias("v")))
    return F.map_from_entries(_let(plain, lambda p: _unique_entries(p, False)))


def iso_compact_date(c: Column) -> Column:
    """F27. ``YYYYMMDD`` at the start as ``YYYY:MM:DD``; other texts stay."""
    return F.when(c.rlike("^\\d{8}$"), F.regexp_replace(c, "^(\\d{4})(\\d{2})(\\d{2})$", "$1:$2:$3")).otherwise(c)


def vector_signature(v: Column, bits: int = 64) -> Column:
    """F28. Bits that tell which components lie above the vector's median, as 32-bit words."""

    def words(x: Column) -> Column:
        s = F.array_sort(x)
        n = bits // 2
        median = (F.element_at(s, n).cast("double") + F.element_at(s, n + 1).cast("double")) / 2
        return _let(median, lambda m: F.transform(F.sequence(F.lit(0), F.lit(bits // 32 - 1)), lambda w: F.aggregate(F.slice(x, w * 32 + 1, F.lit(32)), F.lit(0).cast("long"), lambda acc, y: acc * 2 + F.when(y.cast("double") > m, 1).otherwise(0))))

    return F.when(F.size(v) == bits, _let(v, words))


def dct_signature(luma: Column, size: int = 8, keep: int = 8) -> Column:
    """F29. Median bits of the ``keep`` x ``keep`` low block of the 2-D DCT-II of a ``size`` x ``size`` luma array.

    The transform is linear: each coefficient is one sum of products with a
    constant array. Larger pictures are for ``luma.dct_signatures``.
    """
    m = [[2.0 * math.cos(math.pi * k * (2 * i + 1) / (2 * size)) for i in range(size)] for k in range(keep)]
    px = F.transform(luma, lambda p: p.cast("double"))

    def low(p: Column) -> Column:
        cos = F.array(*[F.array(*[F.lit(x) for x in row]) for row in m])
        rows = lambda r: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda y: F.aggregate(F.zip_with(r, F.slice(p, y * size + 1, F.lit(size)), lambda a, b: a * b), F.lit(0.0), lambda s, z: s + z))
        across = F.transform(cos, rows)
        return _let(across, lambda t: F.flatten(F.transform(cos, lambda r: F.transform(t, lambda col: F.aggregate(F.zip_with(r, col, lambda a, b: a * b), F.lit(0.0), lambda s, z: s + z)))))

    return F.when(F.size(luma) == size * size, vector_signature(_let(px, low), keep * keep))


def tile_signature(luma: Column, size: int = 8, grid: int = 4) -> Column:
    """F30. Block means less the mean, by their deviation, times 64, as whole numbers within ±32000."""
    b = size // grid
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x, lambda s: s / F.size(a))

    def tiles(p: Column) -> Column:
        cells = F.transform(F.sequence(F.lit(0), F.lit(grid * grid - 1)), lambda g: mean(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(b - 1)), lambda r: F.slice(p, ((F.floor(g / grid) * b + r) * size + (g % grid) * b + 1).cast("int"), F.lit(b))))))
        return _let(mean(p), lambda all_: F.transform(cells, lambda x: x - all_))

    def scaled(c: Column) -> Column:
        mid = mean(c)
        sd = F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x, lambda s: s / F.size(c)) - mid * mid)
        return _let(sd, lambda d: F.transform(c, lambda x: F.greatest(F.lit(-32000), F.least(F.lit(32000), F.when(d > 1e-6, F.bround(x / d * 64)).otherwise(0))).cast("smallint")))

    return F.when(F.size(luma) == size * size, _let(_let(F.transform(luma, lambda x: x.cast("double")), tiles), scaled))


def score_to_probability(scores: Column) -> Column:
    """F31. Scores as they are if all lie in 0..1, else through the logistic function (argument within ±30)."""
    squash = F.transform(scores, lambda x: 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), x)))))
    return F.when((F.array_min(scores) < 0) | (F.array_max(scores) > 1), squash).otherwise(scores)


def suggestion_folder_label(folder: Column, q: str) -> Column:
    """F32. The folder from its first segment that contains ``q`` on, or its last segment, after a backslash."""
    parts = segments(folder)
    hits = F.transform(parts, lambda s: norm_tag(s).contains(q))
    at = F.array_position(hits, F.lit(True))
    start = F.when(at > 0, at).otherwise(F.greatest(F.size(parts), F.lit(1)))
    return F.concat(F.lit("\\"), F.array_join(F.slice(parts, start.cast("int"), F.greatest(F.size(parts), F.lit(1))), "\\"))


SQL_FUNCTIONS = {
    "norm_tag": "trim(regexp_replace(translate(lower(coalesce(c, '')), '_', ' '), '\\\\s+', ' '))",
    "natural_key": "regexp_replace(regexp_replace(lower(coalesce(c, '')), '(?<![0-9])([0-9]{1,9})(?![0-9])', concat(chr(1), '000000000$1')), concat(chr(1), '[0-9]*?([0-9]{10})(?![0-9])'), '$1')",
}


def register_functions(spark: SparkSession) -> None:
    """X1. The catalogue's scalar functions for SQL users, as expressions that Catalyst sees through."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION norm_tag(c STRING) RETURNS STRING RETURN {SQL_FUNCTIONS['norm_tag']}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION natural_key(c STRING) RETURNS STRING RETURN {SQL_FUNCTIONS['natural_key']}")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION name_base(c STRING) RETURNS STRING RETURN coalesce(nullif(trim(regexp_replace(regexp_replace(coalesce(c, ''), '(?s)^(.*)\\\\.[^.]*$', '$1'), '[\\\\s_]*\\\\(\\\\d+\\\\)$', '')), ''), regexp_replace(coalesce(c, ''), '(?s)^(.*)\\\\.[^.]*$', '$1'))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION norm_base(c STRING) RETURNS STRING RETURN norm_tag(name_base(c))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION hamming_pct(d INT) RETURNS INT RETURN CASE WHEN d <= 0 THEN 100 ELSE greatest(0, least(99, CAST(floor((1 - d / 256.0D) * 100) AS INT))) END")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION hamming(a ARRAY<BIGINT>, b ARRAY<BIGINT>) RETURNS INT RETURN aggregate(zip_with(a, b, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)")
