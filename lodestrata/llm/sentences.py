"""Sentences of texts in many languages and scripts, in SQL expressions alone.

A text is cut into blocks (fenced code, heading, list item, paragraph). In a
block, marks that end no sentence are masked by private-use placeholders, one
character for one, so that every place stays where it was: decimals, URLs and
paths, initials, abbreviations, ordinals, marks inside quotations and brackets.
Terminators of the scripts then end sentences, and the placeholders turn back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.runtime import spread

# Placeholders, all private-use. Masked marks: one for each mark.
_MARKS = ".!！?？؟。।॥｡"
_MASK = {m: chr(0xE000 + k) for k, m in enumerate(_MARKS)}
_DOT = _MASK["."]
# Quotations: their opening and closing marks, plain or introduced by a colon.
_QUOTED = ["„“", "“”", "«»", "‹›", "「」", "『』", "»«", '""', "‘’", "''"]
_OPENS, _SAIDS, _CLOSES, _UNSAIDS = ([chr(base + k) for k in range(len(_QUOTED))] for base in (0xE020, 0xE030, 0xE040, 0xE050))
# Brackets within a sentence, and around a whole one.
_BRACKETS = ["()", "（）"]
_INS, _OUTS, _FULL_INS, _FULL_OUTS = ([chr(base + k) for k in range(len(_BRACKETS))] for base in (0xE060, 0xE062, 0xE064, 0xE066))
_CUT = chr(0xE0FF)
# The same as ranges for classes of regular expressions.
_OPEN, _SAID, _CLOSE, _UNSAID = (rf"\uE0{k}0-\uE0{k}F" for k in (2, 3, 4, 5))
_IN, _OUT, _FULL_IN, _FULL_OUT = (rf"\uE06{k}\uE06{k + 1}" for k in (0, 2, 4, 6))
_QUOTE, _PAIRED = r"\uE020-\uE05F", r"\uE020-\uE067"
_BACK = {v: k for k, v in _MASK.items()}
for _k, _q in enumerate(_QUOTED):
    _BACK |= {_OPENS[_k]: _q[0], _SAIDS[_k]: _q[0], _CLOSES[_k]: _q[1], _UNSAIDS[_k]: _q[1]}
for _k, _q in enumerate(_BRACKETS):
    _BACK |= {_INS[_k]: _q[0], _FULL_INS[_k]: _q[0], _OUTS[_k]: _q[1], _FULL_OUTS[_k]: _q[1]}

_WS = r"[\s\x1c-\x1f\x85\p{Z}]"
_CF = r"\p{Cf}*"
#: Signs between sentences that say nothing about what starts there.
_SKIP = rf"(?:[\p{{Cf}}\p{{So}}]++{_WS}*+)*+"

_ITEM = r"(?:[-*+•‣]|\d{1,9}[.)])[ \t]"
_FENCE = r"[ \t]*(?:```|~~~)"
_HEAD = r"[ \t]{0,3}#{1,6}[ \t]"
_CONT = rf"(?![ \t\r\f\v\p{{Zs}}]*\n)(?!{_FENCE}|{_HEAD}|[ \t]*[-*+•‣][ \t]|[ \t]*{{ORD}}[.)][ \t])[^\n]+\n?"
#: A text's blocks one after another; nothing lies between them.
BLOCKS = (
    rf"(?m)^{_FENCE}[^\n]*(?:\n(?!{_FENCE}[ \t]*\r?(?:\n|\z))[^\n]*)*+(?:\n{_FENCE}[ \t]*\r?(?=\n|\z))?\n?"
    rf"|^{_HEAD}[^\n]*\n?"
    r"|^[ \t\r\f\v\p{Zs}]*\n"
    rf"|^[ \t]*{_ITEM}[^\n]*\n?(?:{_CONT.replace('{ORD}', r'\d{1,9}')})*+"
    rf"|[^\n]+\n?(?:{_CONT.replace('{ORD}', '1')})*+"
    r"|\n"
)

# --- fixed values: abbreviations by language ---------------------------------
#: Never the end of a sentence.
NEVER = (
    "Dr Mr Mrs Ms Prof St Messrs Gen Col Rev Hon Capt Lt Sgt vs cf Cf viz e.g i.e a.k.a approx incl resp "
    "z.B d.h u.a z.T bzw Bzw vgl Vgl evtl ggf sog Hr Fr Dipl inkl "
    "Mme Mlle MM Me p.ex c.-à-d env "
    "Sr Sra Srta Dra Ing Lic Ud Uds p.ej "
    "напр Напр см См ср Ср им проф акад т.е "
    "डॉ श्री पं प्रो सं पृ "
    "د أ م"
).split()
#: No end before a number.
BEFORE_NUMBER = (
    "no No nos Nos Nr nr Fig fig Figs figs Sec sec sect Sect ch Ch chap Chap cap Cap vol Vol pp p P pg l ll art Art eq Eq ed rev est ver v "
    "Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec Mon Tue Wed Thu Fri Sat Sun ca Ca circa "
    "Abb Abschn Kap Bd S Tab Ziff Abs Anm Av av janv févr avr juil déc núm Núm pág Pág págs tel Tel tab "
    "рис Рис разд Разд стр Стр гл табл ок Ок п пп ст"
).split()
#: Names of months that follow an ordinal.
MONTHS = "Januar Februar März April Mai Juni Juli August September Oktober November Dezember Jänner".split()
#: Words before an ordinal in German.
ORDINALS = "am Am ab Ab der Der des dem den die Die das Das vom Vom zum Zum zur Zur beim im Im bis Bis jeder jede jedes".split()


def _any(words: list[str]) -> str:
    """The words, each also with a capital at its start, as alternatives."""
    both = {w for x in words for w in (x, x[:1].upper() + x[1:])}
    return "|".join(w.replace(".", r"\.") for w in sorted(both, key=lambda w: (-len(w), w)))


_TERMS = r".!?؟।॥。！？｡…"


def _holds(column: Column, *marks: str) -> Column:
    """Whether any of the marks (or, for a lone range, its UTF-8 prefix) occurs; a search of bytes, far cheaper than a pattern."""
    out = column.contains(marks[0])
    for m in marks[1:]:
        out = out | column.contains(m)
    return out


def _holds_bytes(column: Column, *prefixes: bytes) -> Column:
    """Whether any of the byte strings occurs in the text's UTF-8 form."""
    raw = column.cast("binary")
    out = F.contains(raw, F.lit(prefixes[0]))
    for x in prefixes[1:]:
        out = out | F.contains(raw, F.lit(x))
    return out


_BEFORE = r"(?<![\p{L}\d_])"
#: What makes a full stop no end of a sentence; each rule looks around from behind the dot.
_DOT_RULES = [
    # decimals, and dots inside names, paths and addresses
    r"(?=\d)(?<=\d\.)",
    r"(?=\S)(?<=[/@:_~]\.)",
    r"(?=[_/]|[\p{Ll}\d][^\s/@_]*+[/@_]|\p{Ll}{1,4}\b)(?<=[\p{L}\d_)]\.)",
    # initials
    rf"(?<={_BEFORE}\p{{Lu}}\.)(?={_WS}*{_CF}\p{{Lu}}|{_WS}+{_CF}[\p{{L}}\p{{N}}`])",
    # abbreviations of several parts
    rf"(?<={_BEFORE}(?:[zZdDuUтТpPНн]|a\.k|[ei])\.)(?={_WS}?(?:[BThaäеэ]|ex|ej|[дп]|g)\.)",
    rf"(?<={_BEFORE}(?:[zZdDuUтТpPНн]\.{_WS}?(?:[BThaäеэ]|ex|ej)|a\.k\.a|[ei]\.[ge]|c\.-à-d)\.)",
    rf"(?=[ºª°])(?<={_BEFORE}n\.)|(?=-à-d)(?<={_BEFORE}c\.)",
    rf"(?={_WS}?UU\.)(?<={_BEFORE}EE\.)",
    rf"(?={_WS})(?<=(?<![\p{{L}}\p{{M}}\d_])(?:{_any(NEVER)}|M)\.)",
    rf"(?={_WS}*{_SKIP}[\d№#(])(?<=(?<![\p{{L}}\p{{M}}\d_])(?:{_any(BEFORE_NUMBER)})\.)",
    rf"(?={_WS})(?<=(?<![\p{{L}}\d_]|\d{_WS})г\.)",
    # German ordinals (with their lists, of 24 characters at most) and dates
    rf"(?={_WS}+\p{{L}})(?<=\d\.)(?<={_BEFORE}(?:{_any(ORDINALS)}){_WS}{{1,3}}[\d,.]{{1,24}}\.)",
    rf"(?={_WS}+(?:{_any(MONTHS)})\b)(?<=\d\.)",
]
#: A dot to be masked: that of an item's number (kept in group 1), or one by any of the rules.
_DOTS = rf"^([ \t]*\d{{1,9}})\.|\.(?:{'|'.join(_DOT_RULES)})"


#: Runs of characters no step looks for, script by script (a class of one range is tested far faster than one of many
#: members); what is left of a block without them tells which steps it needs.
_TOLD = r"[\x00-\x20#-&*-\-/-9;->@-~]++|[À-ԯ]++|[ؠ-ۓ]++|[ऄ-ॣ]++|[぀-ヿ]++|[一-鿿]++"


def _masked(block: Column, told: Column) -> Column:
    """The block with a placeholder for each full stop that ends no sentence."""
    return F.when(_holds(told, "."), F.regexp_replace(block, _DOTS, f"$1{_DOT}")).otherwise(block)


def _pair_steps() -> list[tuple[list[str], list[str], str, str]]:
    """(marks of which one occurs, and of which one occurs too, pattern, replacement), in order."""
    out = []
    for k, (opened, closed) in enumerate(_QUOTED):
        if opened == closed or opened == "‘":
            # the same sign is an apostrophe elsewhere
            inner = f"{opened}{closed}" + r"\n" * (opened != '"')
            body = rf"{opened}(?<![\p{{L}}\d]{opened})(?=\S)([^{inner}]++)(?<=\S){closed}(?![\p{{L}}\d])"
            out.append(([opened], [closed], body, f"{_OPENS[k]}$1{_CLOSES[k]}"))
            continue
        out.append(([":", "："], [opened], rf"([:：]{_WS}*){opened}([^{opened}{closed}{_OPEN}{_CLOSE}]++){closed}", f"$1{_SAIDS[k]}$2{_UNSAIDS[k]}"))
        out.append(([opened], [closed], rf"{opened}([^{opened}{closed}]++){closed}", f"{_OPENS[k]}$1{_CLOSES[k]}"))
    # brackets: those that hold a whole sentence by themselves, then all others
    for k, (opened, closed) in enumerate(_BRACKETS):
        body = rf"[^{_FULL_IN}()（）]"
        out.append(([opened], [closed], rf"[{opened}](?<=(?:^{_WS}{{0,8}}(?:{_ITEM}{_WS}{{0,4}})?|[{_TERMS}{_CLOSE}{_UNSAID}{_FULL_OUT}]{_WS}{{1,4}}|[。！？{_UNSAID}{_FULL_OUT}])[{opened}])({body}++)(?<=[{_TERMS}])[{closed}]", f"{_FULL_INS[k]}$1{_FULL_OUTS[k]}"))
        out.append(([opened], [closed], rf"[{opened}]([^()（）]*+)[{closed}]", f"{_INS[k]}$1{_OUTS[k]}"))
    return out


def _stepped(df: DataFrame, column: str, told: str, steps) -> DataFrame:
    """``column`` put through the steps one after another, each only where ``told`` has its marks.

    Every step is a projection of its own, so no long expression is written out twice.
    """
    others = [c for c in df.columns if c != column]
    for some, too, pattern, replacement in steps:
        c = F.col(column)
        df = df.select(*others, F.when(_holds(F.col(told), *some) & _holds(F.col(told), *too), F.regexp_replace(c, pattern, replacement)).otherwise(c).alias(column))
    return df


_BLANKS = " \t\n\r\f\v\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def _inside(w: Column, borders: str, closing: str) -> Column:
    """Marks inside quotations (or brackets) masked, but for the last before their end.

    The text is taken apart into runs without ``borders``; a run that ends with
    one of ``closing`` lies inside.
    """
    runs = F.regexp_extract_all(w, F.lit(rf"[^{borders}]++[{closing}]?|[{borders}]"), F.lit(0))
    paired = "".join(_OPENS + _SAIDS + _CLOSES + _UNSAIDS + _INS + _OUTS + _FULL_INS + _FULL_OUTS)

    def one(run: Column) -> Column:
        kept = F.length(F.rtrim(run, F.lit(_BLANKS + paired)))
        masked = F.concat(F.translate(F.substring(run, F.lit(1), kept - 1), _MARKS, "".join(_MASK.values())), F.substring(run, F.greatest(kept, F.lit(1)), F.length(run)))
        return F.when(F.substring(run, -1, 1).rlike(f"[{closing}]") & (kept > 1), masked).otherwise(run)

    return F.array_join(F.transform(runs, one), "")


#: What a new sentence may start with: no lower-case word, unless it is a name out of code.
_CODE = r"\p{Ll}[\p{L}\d]*(?:[_/(]|[.\uE000]\p{L}|::)"
_STARTS = rf"(?:[\p{{Lu}}\p{{Lt}}\p{{N}}¿¡`~@#\[<{_OPEN}{_SAID}{_IN}{_FULL_IN}\"'„“«‘「『（《(]|{_CODE})"
_LETTERS = r"[\p{Lo}\p{Lm}]"
_THAI = r"[\u0E01-\u0E3A\u0E40-\u0E4E]"


def _ends() -> tuple[str, str, str]:
    """Patterns whose match ends with a sentence's last character: for blanks between sentences, for scripts without, for Thai."""
    # a quotation's end asks for more than a letter without case
    quote, bracket = rf"{_WS}?[{_CLOSE}{_UNSAID}]", f"[{_OUT}]"
    spaced = [
        rf"[.!?؟।॥…]++(?:{quote}|{bracket})++(?={_CF}{_WS}+{_SKIP}{_STARTS})",
        rf"[.!?؟।॥…]+[{_FULL_OUT}]",
        rf"(?:[!?؟।॥]|(?<![.…])\.(?![.…]))++[)\]*_]*(?={_CF}{_WS}+{_SKIP}(?:{_STARTS}|{_LETTERS}))",
        rf"(?:\.{{2,}}|…)[.…!?]*(?={_CF}{_WS}+{_SKIP}{_STARTS})",
        # no blank behind the full stop
        r"\.(?=\p{Lu}\p{Ll}+ )(?<=\p{Ll}{2}\.)",
    ]
    close = [
        rf"[。！？｡]+[{_FULL_OUT}]",
        rf"[。！？｡]+[{_UNSAID}](?![，、,とっ])",
        rf"[。！？｡]+[{_CLOSE}](?={_WS}*[{_OPEN}{_SAID}{_FULL_IN}])",
        rf"[。！？｡][。！？｡!?]*+(?![{_CLOSE}{_UNSAID}{_OUT}{_FULL_OUT}])",
    ]
    return rf"({'|'.join(spaced)})", rf"(?=[。！？｡])({'|'.join(close)})", rf"(?<={_THAI})(?=[ \t\xa0]+{_THAI})"


def _cut(df: DataFrame, column: str, told: str) -> DataFrame:
    """``column`` with a cut behind the last character of each sentence."""
    others = [c for c in df.columns if c != column]
    spaced, close, thai = _ends()
    many, ascii_ = _holds(F.col(told), *"؟।॥…"), _holds(F.col(told), *".!?")
    steps = [
        (many, f"(?=[.!?؟।॥…]){spaced}", f"$1{_CUT}"),
        (~many & ascii_, f"(?=[.!?]){spaced}", f"$1{_CUT}"),
        (_holds(F.col(told), *"。！？｡"), close, f"$1{_CUT}"),
        (_holds_bytes(F.col(told), b"\xe0\xb8", b"\xe0\xb9"), thai, _CUT),
    ]
    for gate, pattern, replacement in steps:
        c = F.col(column)
        df = df.select(*others, F.when(gate, F.regexp_replace(c, pattern, replacement)).otherwise(c).alias(column))
    return df


#: The placeholders' own places, and where characters of a text that lie there wait meanwhile: a plane without any character.
_TAKEN = "".join(chr(0xE000 + k) for k in range(256))
_ASIDE = "".join(chr(0xB0000 + k) for k in range(256))


def sentence_pieces(documents: DataFrame) -> DataFrame:
    """(doc_id, block_no, piece_no, piece): masked pieces that together make up each text."""
    taken = _holds_bytes(F.col("text"), b"\xee\x80", b"\xee\x81", b"\xee\x82", b"\xee\x83")
    clean = F.when(taken, F.translate("text", _TAKEN, _ASIDE)).otherwise(F.col("text"))
    texts = documents.where(F.col("doc_id").isNotNull() & F.col("text").rlike(r"[^\s\p{Z}\p{Cf}\p{Cc}]")).select("doc_id", clean.alias("text"))
    blocks = spread(texts).select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(BLOCKS), F.lit(0))).alias("block_no", "block"))
    whole = F.col("block").rlike(rf"^(?:{_FENCE}|{_HEAD})")
    told = blocks.select("doc_id", "block_no", "block", F.when(~whole, F.regexp_replace("block", _TOLD, "")).alias("told"))
    works = F.col("told").rlike(rf"[{_TERMS}]|{_THAI}")
    # A block that is one piece has nothing to work on; null passes through all steps at no cost.
    worked = told.select("doc_id", "block_no", F.when(works, F.lit(None)).otherwise(F.col("block")).alias("as_is"), F.when(works, F.col("told")).alias("told"), F.when(works, F.col("block")).alias("w"))
    worked = worked.select("doc_id", "block_no", "as_is", "told", _masked(F.col("w"), F.col("told")).alias("w"))
    worked = _stepped(worked, "w", "told", _pair_steps())
    for borders, closing, closes in ((_QUOTE, _CLOSE + _UNSAID, "”»›」』\"'’“«"), (r"\uE060-\uE067", _OUT + _FULL_OUT, ")）")):
        # a mark inside that isn't the last
        held = _holds(F.col("told"), *closes) & _holds_bytes(F.col("w"), b"\xee\x80", b"\xee\x81") & F.col("w").rlike(rf"[{_MARKS}](?={_WS}*+[^{_PAIRED}])[^{borders}]*+[{closing}]")
        worked = worked.select("doc_id", "block_no", "as_is", "told", F.when(held, _inside(F.col("w"), borders, closing)).otherwise(F.col("w")).alias("w"))
    worked = _cut(worked, "w", "told")
    return worked.select("doc_id", "block_no", F.posexplode(F.when(F.col("as_is").isNull(), F.split("w", _CUT, -1)).otherwise(F.array("as_is"))).alias("piece_no", "piece"))


def sentences(documents: DataFrame, with_text: bool = True) -> DataFrame:
    """The sentences of every text: doc_id, start_char, end_char and, ``with_text``, sentence.

    Places count characters (code points); end_char is the number of characters
    up to and with the sentence's last. Null and blank texts have no sentence.
    The rules follow the scripts in the text; the document's own language code
    is not asked. Quotations and brackets are paired within their block at any
    length. Private-use characters in a text come back unchanged; characters
    U+B0000 to U+B00FF, which Unicode doesn't assign, come back as private-use
    ones. doc_id is taken to be unique; extra columns are ignored.
    """
    edge = r"[\s\x1c-\x1f\x85\p{Z}]"
    pieces = sentence_pieces(documents).select("doc_id", "block_no", "piece_no", F.length("piece").alias("size"), _restored(F.col("piece")).alias("piece"))
    # only the last piece of a block ends with blanks, only those behind another start with them
    ended = pieces.select("doc_id", "block_no", "piece_no", "size", F.when(F.substring("piece", -1, 1).rlike(edge), F.regexp_replace("piece", rf"{edge}++\z", "")).otherwise(F.col("piece")).alias("piece"))
    rows = ended.select("doc_id", "block_no", "piece_no", "size", F.length("piece").alias("kept"), F.when(F.substring("piece", 1, 1).rlike(edge), F.regexp_replace("piece", rf"^{edge}++", "")).otherwise(F.col("piece")).alias("sentence"))
    rows = rows.select("doc_id", "block_no", "piece_no", "size", "kept", F.length("sentence").alias("length"), *(["sentence"] if with_text else []))
    w = Window.partitionBy("doc_id").orderBy("block_no", "piece_no").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("before", F.coalesce(F.sum("size").over(w), F.lit(0))).where("kept > 0")
    return placed.select("doc_id", (F.col("before") + F.col("kept") - F.col("length")).cast("bigint").alias("start_char"), (F.col("before") + F.col("kept")).cast("bigint").alias("end_char"), *(["sentence"] if with_text else []))


def _restored(piece: Column) -> Column:
    """Placeholders back to the marks they stand for, and characters set aside back to their places."""
    masked = _holds_bytes(piece, b"\xee\x80", b"\xee\x81", b"\xf2\xb0")
    return F.when(masked, F.translate(piece, "".join(_BACK) + _ASIDE, "".join(_BACK.values()) + _TAKEN)).otherwise(piece)
