"""Whitespace tables: predictions, quality, energy, rankings, profiles, covariances. Input is (file, ord, line)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import prefix


def fields(line: Column | str = "line") -> Column:
    return F.split(F.trim(F.col(line) if isinstance(line, str) else line), r"\s+")


def _need(condition: Column, value: Column, message: str, kind: str) -> Column:
    return F.when(condition, value).otherwise(F.raise_error(F.concat(F.lit(message + ": "), F.col("line"))).cast(kind))


def predictions(rows: DataFrame, sizes: tuple[int, ...] = (4, 14), predictor: int | None = None) -> DataFrame:
    """(file, predictor, r1, r2, dst, prob, p); a line with another number of fields is an error.

    ``sizes`` empty accepts four fields or more.
    """
    f = fields()
    fits = F.size(f).isin(*sizes) if sizes else F.size(f) >= 4
    kept = rows.filter((F.trim("line") != "") & ~F.trim("line").startswith("#")).select("file", _need(fits, f, "a prediction has another number of fields", "array<string>").alias("f"))
    num = F.transform(F.slice("f", 5, F.greatest(F.size("f") - 4, F.lit(0))), lambda x: x.cast("double"))
    tag = F.lit(predictor).cast("int").alias("predictor")
    return kept.select("file", tag, F.col("f")[0].cast("int").alias("r1"), F.col("f")[1].cast("int").alias("r2"), F.col("f")[2].cast("double").alias("dst"), F.col("f")[3].cast("double").alias("prob"), num.alias("p"))


def quality(rows: DataFrame) -> DataFrame:
    """(file, part, ord, name, global, local): header, body and footer of quality files; X is null.

    A body row is a name, a number and numbers or X; rows of different width or a name that occurs twice in a file are errors.
    """
    body = F.trim("line").rlike(r"^\S+\s+[0-9.eE+-]+(\s+([0-9.eE+-]+|X))+$")
    w = Window.partitionBy("file")
    marked = rows.withColumn("body", body).withColumn("first", F.min(F.when(F.col("body"), F.col("ord"))).over(w))
    part = F.when(F.col("body"), 1).when(F.col("first").isNull() | (F.col("ord") < F.col("first")), 0).otherwise(2)
    f = fields()
    marked = marked.withColumns({"part": part, "f": F.when(F.col("body"), f)}).withColumn("name", F.col("f")[0])
    width = F.size("f")
    v = Window.partitionBy("file", "name")
    even = ~F.col("body") | (F.min(F.when(F.col("body"), width)).over(w) == F.max(F.when(F.col("body"), width)).over(w))
    single = ~F.col("body") | (F.count("*").over(v) == 1)
    checked = marked.withColumn("ok", even & single)
    local = F.transform(F.slice("f", 3, F.greatest(width - 2, F.lit(0))), lambda x: F.when(x == "X", None).otherwise(x.try_cast("double")))
    name = F.when(F.col("ok"), F.col("name")).otherwise(F.raise_error(F.concat(F.lit("uneven or repeated row: "), "line")).cast("string"))
    return checked.select("file", "part", "ord", name.alias("name"), F.col("f")[1].try_cast("double").alias("global"), F.when(F.col("body"), local).alias("local"), F.when(F.col("part") != 1, F.col("line")).alias("line"))


def energy(rows: DataFrame, fixed: int | None = 29) -> DataFrame:
    """(file, resnum, terms): the header line is skipped, insertion letters go.

    With ``fixed`` each line needs that many fields and all numeric ones are terms; without, terms are those between the third field
    and the last two.
    """
    f = fields()
    kept = rows.filter((F.col("ord") > 0) & (F.trim("line") != ""))
    if fixed is not None:
        kept = kept.select("file", "line", _need(F.size(f) == fixed, f, f"an energy line needs {fixed} fields", "array<string>").alias("f"))
        terms = F.transform("f", lambda x: x.try_cast("double"))
    else:
        kept = kept.select("file", "line", f.alias("f"))
        terms = F.transform(F.slice("f", 4, F.greatest(F.size("f") - 5, F.lit(0))), lambda x: x.try_cast("double"))
    return kept.select("file", F.regexp_replace(F.col("f")[1], "[A-Za-z]$", "").try_cast("int").alias("resnum"), terms.alias("terms"))


def eval_summary(rows: DataFrame) -> DataFrame:
    """(config, mean, sd, target, t_mean, t_sd) from lines 'name mean sd | (target mean sd)*'; a name that occurs twice in the input, or a
    line of another width, is an error."""
    f = fields()
    every, name = Window.partitionBy("file"), Window.partitionBy("config")
    kept = rows.filter(F.trim("line") != "").select("file", "line", f.alias("f"), f[0].alias("config"))
    even = F.min(F.size("f")).over(every) == F.max(F.size("f")).over(every)
    kept = kept.withColumn("ok", even & (F.count("*").over(name) == 1)).withColumn("f", _need(F.col("ok"), F.col("f"), "an uneven line, or a model that already exists", "array<string>"))
    triples = F.transform(F.sequence(F.lit(5), F.greatest(F.size("f") - 2, F.lit(5)), F.lit(3)), lambda k: F.slice("f", k, 3))
    long = kept.select("f", F.explode_outer(F.filter(triples, lambda t: F.size(t) == 3)).alias("t"))
    return long.select(F.col("f")[0].alias("config"), F.col("f")[1].cast("double").alias("mean"), F.col("f")[2].cast("double").alias("sd"), F.col("t")[0].alias("target"), F.col("t")[1].cast("double").alias("t_mean"), F.col("t")[2].cast("double").alias("t_sd"))


def ground_truth(rows: DataFrame) -> DataFrame:
    """(target, name, gt_rank); what follows a dash in the name goes."""
    m = lambda k: F.regexp_extract("line", r"^\s*(\d+)\s+([^\-\s]+)", k)
    return rows.select(F.col("file").alias("target"), m(2).alias("name"), m(1).try_cast("int").alias("gt_rank")).filter("gt_rank IS NOT NULL")


def scaled_values(line: Column, scale: float, skip: tuple[int, ...] = ()) -> Column:
    """The numbers of a line divided by the scale, without those at the skipped places."""
    nums = F.transform(F.split(F.trim(line), r"\s+"), lambda x: x.try_cast("double") / scale)
    return F.filter(nums, lambda x, i: ~i.isin(*skip)) if skip else nums


# The residues' order in a profile's codes.
PROFILE_RESIDUES = "ARNDCQEGHILKMFPSTWYVBZJX"


def profile(rows: DataFrame, stretch: int = prefix.STRETCH) -> DataFrame:
    """(file, pos, res, attrs): profiles with eight records for each position; 59 values each.

    'LEN: n' and 'SCALE: n' come first. A position begins with 'pos res' and 20 target probabilities; lines that begin with white space
    follow: 9 transition probabilities (without the sixth and the eighth), 3 effective numbers of observations in thousandths, a
    background posterior and a number of posteriors (left out, but it has to be positive), posteriors (the largest counts), indexes (the
    first counts, unscaled), 'CV:' and 22 context values (without the third), 'SS:' and 3 state probabilities. The values begin with the
    position and the residue's place in ``PROFILE_RESIDUES``. Another number of fields, or records missing, are errors.
    """
    f = F.split(F.rtrim("line"), r"\s+")
    start = F.col("line").rlike(r"^\d+\s+[A-Za-z]\s")
    scales = rows.filter(f[0] == "SCALE:").groupBy("file").agg(F.max(f[1].try_cast("double")).alias("scale"))
    marked = prefix.summed(prefix.stretches(rows.withColumns({"f": f, "s": start.cast("int")}), ["file"], "ord", stretch), {"g": F.col("s")}).join(scales, "file", "left")
    marked = marked.filter((F.col("g") > 0) & ((F.col("s") == 1) | (F.col("line").rlike(r"^\s+\S"))))
    k = F.row_number().over(Window.partitionBy("file", "g").orderBy("ord"))
    marked = marked.withColumn("k", k).withColumn("v", F.when(F.col("k").isin(1, 7, 8), F.slice("f", 3, F.greatest(F.size("f") - 2, F.lit(0)))).otherwise(F.slice("f", 2, F.greatest(F.size("f") - 1, F.lit(0)))))
    n, k, tag = F.size("v"), F.col("k"), F.col("f")[1]
    number = lambda i: F.col("v")[i].try_cast("double")
    fits = F.when(k == 1, (n == 20) & (F.position(F.upper(tag), F.lit(PROFILE_RESIDUES)) > 0)).when(k == 2, n == 9).when(k == 3, n == 3).when(k == 4, (n == 2) & (number(1) > 0))
    fits = fits.when(k.isin(5, 6), n >= 1).when(k == 7, (n == 22) & (tag == "CV:")).when(k == 8, (n == 3) & tag.startswith("SS:")).otherwise(F.lit(False))
    by = F.when(k == 3, F.lit(1000.0)).when(k == 6, F.lit(1.0)).otherwise(F.col("scale"))
    nums = F.transform("v", lambda x: (x.try_cast("double") / by).cast("float"))
    kept = F.when(k == 2, F.filter(nums, lambda x, i: ~i.isin(5, 7))).when(k.isin(4, 5, 6), F.slice(nums, 1, 1)).when(k == 7, F.filter(nums, lambda x, i: i != 2)).otherwise(nums)
    own = F.array(F.col("f")[0].try_cast("float"), (F.position(F.upper(tag), F.lit(PROFILE_RESIDUES)) - 1).cast("float"))
    values = _need(fits & F.col("scale").isNotNull(), F.when(k == 1, F.concat(own, kept)).otherwise(kept), "not a record of a profile", "array<float>")
    one = marked.select("file", "g", "k", tag.alias("res"), values.alias("v"))
    found = one.groupBy("file", F.col("g").cast("int").alias("pos")).agg(F.max(F.when(F.col("k") == 1, F.col("res"))).alias("res"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda x: x["v"])).alias("attrs"))
    whole = F.when(F.size("attrs") == 59, F.col("attrs")).otherwise(F.raise_error(F.concat(F.lit("values at position "), F.col("pos").cast("string"), F.lit(": "), F.size("attrs").cast("string"))).cast("array<float>"))
    return found.select("file", "pos", "res", whole.alias("attrs"))


def xcov(rows: DataFrame, width: int = 401) -> DataFrame:
    """(file, i, j, xcov), upper triangle, ``width`` values each; comments start with #, and a header 'Length= n xcov_size= width' with
    another width is an error."""
    f = fields()
    head = F.trim("line").startswith("Length=")
    right = F.when(head, F.regexp_extract("line", r"xcov_size=\s+(\d+)", 1) == str(width)).otherwise(F.size(f) == width + 2)
    kept = rows.filter((F.trim("line") != "") & ~F.trim("line").startswith("#")).select("file", _need(right, f, f"a covariance needs {width} values", "array<string>").alias("f"), head.alias("h"))
    kept = kept.filter((F.size("f") > 0) & ~F.col("h"))  # the check comes first, so that the header is checked too
    i, j = F.col("f")[0].cast("int"), F.col("f")[1].cast("int")
    return kept.select("file", i.alias("i"), j.alias("j"), F.transform(F.slice("f", 3, width), lambda x: x.cast("float")).alias("xcov")).filter("i <= j")


def profile_record(rows: DataFrame, name: str) -> DataFrame:
    """The first record whose FILE: begins with this name, from a database whose records end in '*'; rows (ord, line) hold a record each."""
    file = F.regexp_extract("line", r"(?m)^FILE:\s+(\S+)", 1)
    return rows.filter((F.lit(name) != "") & file.startswith(name)).orderBy("ord").limit(1)


def profile_to_seq(profile_rows: DataFrame) -> DataFrame:
    """(file, seq)."""
    letters = F.transform(F.array_sort(F.collect_list(F.struct("pos", "res"))), lambda x: x["res"])
    return profile_rows.groupBy("file").agg(F.array_join(letters, "").alias("seq"))


def atoms(rows: DataFrame, chain: str | None = None, hetatm: bool = True) -> DataFrame:
    """(file, serial, atom, resname, chain, resnum, icode, x, y, z, het) of the first model; the first chain unless one is named."""
    ends = rows.filter(F.col("line").startswith("ENDMDL")).groupBy("file").agg(F.min("ord").alias("e"))
    kept = rows.join(ends, "file", "left").filter((F.col("e").isNull() | (F.col("ord") < F.col("e"))) & (F.col("line").startswith("ATOM") | (F.lit(hetatm) & F.col("line").startswith("HETATM"))))
    at = lambda a, n: F.trim(F.substring("line", a, n))
    cols = kept.select(
        "file", "ord", at(7, 5).try_cast("int").alias("serial"), at(13, 4).alias("atom"), at(18, 3).alias("resname"), F.substring("line", 22, 1).alias("chain"), at(23, 4).try_cast("int").alias("resnum"), at(27, 1).alias("icode"),
        at(31, 8).try_cast("double").alias("x"), at(39, 8).try_cast("double").alias("y"), at(47, 8).try_cast("double").alias("z"), F.col("line").startswith("HETATM").alias("het"),
    )
    if chain is not None:
        return cols.filter(F.col("chain") == chain).drop("ord")
    first = cols.groupBy("file").agg(F.min_by("chain", "ord").alias("chain"))
    return cols.join(first, ["file", "chain"], "left_semi").select(*[c for c in cols.columns if c != "ord"])


def atoms_mmcif(rows: DataFrame, chain: str | None = None) -> DataFrame:
    """S06 for mmCIF: the same columns from an atom_site loop, by the names of its items."""
    item = F.regexp_extract("line", r"^_atom_site\.(\S+)", 1)
    names = rows.filter(item != "").groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", item.alias("n")))), lambda x: x["n"]).alias("names"))
    kept = rows.filter(F.col("line").rlike(r"^(ATOM|HETATM)\s")).join(names, "file").withColumn("f", fields())
    at = lambda n: F.try_element_at("f", F.array_position("names", F.lit(n)).cast("int"))
    cols = kept.select(
        "file", "ord", at("id").try_cast("int").alias("serial"), F.regexp_replace(at("label_atom_id"), '"', "").alias("atom"), at("label_comp_id").alias("resname"), at("auth_asym_id").alias("chain"), at("auth_seq_id").try_cast("int").alias("resnum"),
        F.regexp_replace(at("pdbx_PDB_ins_code"), r"[?.]", "").alias("icode"), at("Cartn_x").try_cast("double").alias("x"), at("Cartn_y").try_cast("double").alias("y"), at("Cartn_z").try_cast("double").alias("z"),
        (at("group_PDB") == "HETATM").alias("het"), F.coalesce(at("pdbx_PDB_model_num"), F.lit("1")).alias("model"),
    ).filter("model = '1'").drop("model")
    if chain is not None:
        return cols.filter(F.col("chain") == chain).drop("ord")
    first = cols.groupBy("file").agg(F.min_by("chain", "ord").alias("chain"))
    return cols.join(first, ["file", "chain"], "left_semi").select(*[c for c in cols.columns if c != "ord"])
