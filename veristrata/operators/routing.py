"""Fields of a value, and where it goes: measurement type, terms, routing, query variants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.period import let

# Fixed values of the vocabulary.
OFFICIAL = "공식집계"
OUT_OF_SCOPE = ("민간조사", "정책목표", "잠정추산", "법정기준")


def route(subtype: Column, indicator: Column, value_text: Column, clarify: Column, threshold: float = 0.5) -> Column:
    """struct(routing_class, confidence, reason): clarification, out of scope, repeated value, official, indicator, no claim."""
    blank = F.coalesce(F.trim(indicator), F.lit("")) == ""
    bare = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", "")
    repeated = bare(value_text).rlike(r"\d") & F.contains(bare(indicator), bare(value_text))
    sub = F.coalesce(F.trim(subtype), F.lit(""))
    to = lambda c, p, r: F.struct(F.lit(c).alias("routing_class"), F.lit(p).alias("confidence"), (F.lit(r) if isinstance(r, str) else r).alias("reason"))
    weak = to("KOSIS_CANDIDATE", 0.5, "INDICATOR_WITHOUT_RESOLVED_REGION") if threshold <= 0.5 else to("NOT_CLAIM", 0.5, "INDICATOR_WITHOUT_RESOLVED_REGION_BELOW_THRESHOLD")
    return (
        F.when(F.coalesce(clarify, F.lit(False)), to("CLARIFICATION_REQUIRED", 0.0, "INDICATOR_FIELD_CLARIFICATION_REQUIRED"))
        .when(sub.isin(*OUT_OF_SCOPE), to("OUT_OF_SCOPE", 1.0, F.concat(F.lit("SOURCE_SUBTYPE_"), sub)))
        .when(repeated, to("NOT_CLAIM", 1.0, "VALUE_REPEATED_INSIDE_INDICATOR"))
        .when(sub == OFFICIAL, to("KOSIS_CANDIDATE", 1.0, "OFFICIAL_AGGREGATE_REGION"))
        .when(~blank, weak)
        .otherwise(to("NOT_CLAIM", 1.0, "NO_INDICATOR_NO_REGION"))
    )


#: Ends of an indicator that tell what it measures, and words for a move after the value (fixed values).
RATE_ENDS = ("증가율", "감소율", "상승률", "하락률", "증감률", "변화율", "변동률", "성장률")
POINT_ENDS = (
    "증감폭", "증가폭", "감소폭", "상승폭", "하락폭", "변화폭", "변동폭", "증감량", "증가량", "감소량", "상승량", "하락량", "변화량", "변동량", "전월차",
    "전년동월차", "차이", "증감액", "증가금액", "감소금액", "증감인원", "증가인원", "감소인원", "증가수", "감소수", "변화",
)
LEVEL_ENDS = ("비율", "비중", "점유율", "연체율", "고용률", "실업률", "출산율", "증가세")
MOVES = ("늘어", "늘었", "증가", "줄어", "줄었", "감소", "상승", "하락", "올랐", "내렸", "급증", "급감", "확대", "축소", "뛰", "떨어")
MOVES_AT_ONCE = ("늘어", "늘었", "증가", "줄어", "줄었", "감소", "상승", "하락", "올랐", "내렸", "급증", "급감", "확대", "축소", "뛰", "떨어", "오른", "내려")
MODERATORS = ("약", "대략", "가량", "정도", "넘게", "더")
#: The value is what something was, became or was counted as (fixed value).
COMPLEMENT = r"^\s*(?:이었|였|이다|이며|이고|다(?:\s|[.,]|$)|으로\s*(?:집계|기록|나타|내렸|올랐))"


def measurement_type(indicator: Column, unit: Column, tail: Column) -> Column:
    """INDEX_LEVEL, LEVEL, CHANGE_RATE or CHANGE_POINT, by the indicator's end, the unit, and the 20 characters after value and unit.

    An index stays one. A value that something was or became is a level, unless it is in points.
    A percentage that moved is a rate. Points, and ends that name a difference, are changes; so is
    any other value that at once is said to have moved, unless the indicator is a ratio.
    """
    label, u, t = F.regexp_replace(F.coalesce(indicator, F.lit("")), r"\s+", ""), F.coalesce(unit, F.lit("")), F.coalesce(tail, F.lit(""))
    ends = lambda words: label.rlike(f"(?:{'|'.join(words)})$")
    points, percent = u.rlike("포인트|%[pP]") | t.rlike("^[pP]"), u == "%"
    at_once = t.rlike(rf"^\s*(?:(?:{'|'.join(MODERATORS)})\s*)?(?:{'|'.join(MOVES_AT_ONCE)})")
    return (
        F.when(ends(["지수"]), "INDEX_LEVEL")
        .when(~points & t.rlike(COMPLEMENT), "LEVEL")
        .when(~points & percent & t.rlike("|".join(MOVES)), "CHANGE_RATE")
        .when(points | ends(POINT_ENDS), "CHANGE_POINT")
        .when(ends(RATE_ENDS), "CHANGE_RATE")
        .when(~ends(LEVEL_ENDS) & ~percent & at_once, "CHANGE_POINT")
        .otherwise("LEVEL")
    )


#: Words at the head of an indicator that no table is titled by (fixed values).
HEADS = {"scope": ("한국", "한국의", "대한민국", "대한민국의", "우리나라", "우리나라의"), "temporal": ("초기", "말기", "초반", "중반", "후반", "당시"), "projection": ("미래", "향후", "장래")}


def strip_modifiers(indicator: Column) -> Column:
    """struct(indicator, scope, temporal, projection): head words taken off one after the other, and kept by kind; the whole if nothing else is left."""
    tokens = F.filter(F.split(F.trim(F.coalesce(indicator, F.lit(""))), r"\s+"), lambda x: x != "")
    every = [w for words in HEADS.values() for w in words]

    def split_at(t: Column) -> Column:
        stays = F.filter(F.transform(t, lambda x, i: F.when(~x.isin(*every), i + 1)), lambda i: i.isNotNull())
        n = F.coalesce(F.get(stays, F.lit(0)), F.size(t) + 1) - 1  # head words before the first other one
        head, rest = F.slice(t, F.lit(1), n), F.array_join(F.slice(t, n + 1, F.size(t) + 1), " ")
        of_kind = lambda words: F.filter(head, lambda x: x.isin(*words))
        kinds = [of_kind(words).alias(k) for k, words in HEADS.items()]
        return F.struct(F.when(rest != "", rest).otherwise(F.trim(F.coalesce(indicator, F.lit("")))).alias("indicator"), *kinds)

    return let(tokens, split_at)


#: Population nouns, and facets, that a table can be filtered by (fixed values; regions by their ends).
POPULATION = ("개인사업자", "자영업자", "근로자", "노동자", "취업자", "실업자", "가구원", "가구", "인구", "주민", "학생", "환자", "사업체", "기업", "농가", "어가", "청년", "고령자", "노인", "외국인")
FACETS = ("대기업", "중견기업", "중소기업", "비수도권", "남성", "여성", "청년층", "고령층", "제조업", "서비스업", "건설업", "농림어업", "공공부문", "민간부문")
REGIONS = ("전국", "수도권", "서울", "부산", "대구", "인천", "광주", "대전", "울산", "세종", "경기", "강원", "충북", "충남", "전북", "전남", "경북", "경남", "제주")
METRIC_ENDS = ("증가율", "감소율", "상승률", "하락률", "증감률", "변화율", "성장률", "비율", "비중", "점유율", "지수")


def _named(text: Column, words) -> Column:
    """The words that a text holds, each once, in order of place; of words that begin alike the longer."""
    pattern = "|".join(sorted(words, key=lambda w: (-len(w), w)))
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({pattern})"), 1))


def population_terms(indicator: Column, sentence: Column) -> Column:
    """Population words of the indicator; of the sentence, without quoted titles, only if it names none."""
    unquoted = F.regexp_replace(F.coalesce(sentence, F.lit("")), "['\"‘’“”][^'\"‘’“”]*['\"‘’“”]", " ")
    return let(_named(indicator, POPULATION), lambda own: F.when(F.size(own) > 0, own).otherwise(_named(unquoted, POPULATION)))


def dimension_terms(indicator: Column, sentence: Column) -> Column:
    """Regions and facets of the indicator; else of the sentence."""
    return let(_named(indicator, REGIONS + FACETS), lambda own: F.when(F.size(own) > 0, own).otherwise(_named(sentence, REGIONS + FACETS)))


def item_terms(indicator: Column) -> Column:
    """The indicator without its metric's name and its facets; nothing if that leaves it whole or empty."""
    whole = F.trim(F.coalesce(indicator, F.lit("")))
    facets = "|".join(sorted(REGIONS + FACETS, key=lambda w: (-len(w), w)))
    bare = F.trim(F.regexp_replace(F.trim(F.regexp_replace(whole, rf"\s*(?:{'|'.join(METRIC_ENDS)})$", "")), facets, ""))
    return F.when((bare != "") & (bare != whole), F.array(bare)).otherwise(F.array().cast("array<string>"))


def query_variants(indicator: Column, item: Column, sentence: Column) -> Column:
    """Distinct queries in order: the indicator, the item unless it is part of it, the sentence without its numbers."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(sentence, r"[-−]?\d[\d,.]*", " "), r"\s+", " "))
    part = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("query"))
    all_of = F.array(
        F.when(F.coalesce(indicator, F.lit("")) != "", part("indicator", indicator)),
        F.when((F.coalesce(item, F.lit("")) != "") & ~F.coalesce(F.contains(indicator, item), F.lit(False)), part("item", item)),
        F.when(F.coalesce(plain, F.lit("")) != "", part("sentence", plain)),
    )
    return F.array_compact(all_of)


#: Words of a question about statistics, and of an article (fixed values).
STATISTICS = (
    "인구", "출생", "사망", "혼인", "이혼", "취업", "고용", "실업", "물가", "소득", "가구", "사업체", "수출", "수입", "생산", "소비", "gdp", "국내총생산", "통계", "증가율",
    "감소율", "비율", "비중", "지수", "인원", "명", "건", "%", "퍼센트",
)
ASKING = ("얼마", "몇", "알려", "조회", "찾아", "증가", "감소", "높", "낮", "비교", "인가", "인가요", "했나", "했나요", "어디", "언제", "?")
REPORTING = ("기자", "입력", "보도했다", "밝혔다", "전했다", "따르면", "뉴스")
SENTENCE_END = r"[.!?。](?:\s|$)"


def input_route(text: Column, input_type: Column | None = None) -> Column:
    """struct(route, confidence, reason): a web address, a short statistical question, an article, or none of them.

    A stated ``input_type`` (url, query or article; null or auto: none) goes before what the text looks like; a stated
    query that is no statistical question is out of scope.

    A question has at most 300 characters and two sentences, a word of statistics and one that
    asks. An article has 400 characters, three lines, three sentences or a word of reporting.
    """
    plain = F.trim(F.coalesce(text, F.lit("")))
    flat = F.regexp_replace(plain, r"\s+", " ")
    has = lambda c, words: c.rlike("|".join(w for w in words if w != "?")) | (F.contains(c, F.lit("?")) if "?" in words else F.lit(False))
    ends = lambda c: F.regexp_count(c, F.lit(SENTENCE_END))
    question = (flat != "") & (F.length(flat) <= 300) & (ends(flat) <= 2) & has(F.lower(flat), STATISTICS) & has(flat, ASKING)
    article = (F.length(plain) >= 400) | (F.regexp_count(plain, F.lit("\n")) >= 2) | (ends(plain) >= 3) | has(plain, REPORTING)
    to = lambda r, c, why: F.struct(F.lit(r).alias("route"), F.lit(c).alias("confidence"), F.lit(why).alias("reason"))
    stated = F.lower(F.coalesce(input_type if input_type is not None else F.lit(None).cast("string"), F.lit("auto")))
    return (
        F.when(stated == "url", to("ARTICLE_URL", 1.0, "EXPLICIT_URL")).when((stated == "query") & question, to("SIMPLE_KOSIS_QUERY", 1.0, "EXPLICIT_KOSIS_QUERY"))
        .when(stated == "query", to("OUT_OF_SCOPE", 1.0, "EXPLICIT_QUERY_NOT_KOSIS_ELIGIBLE")).when(stated == "article", to("ARTICLE_TEXT", 1.0, "EXPLICIT_ARTICLE_TEXT"))
        .when(plain.rlike(r"(?i)^https?://(?:[^/?#\s]*@)?[^/?#@:\s]"), to("ARTICLE_URL", 1.0, "HTTP_URL"))
        .when(question, to("SIMPLE_KOSIS_QUERY", 0.9, "SHORT_STATISTICAL_QUESTION"))
        .when(article, to("ARTICLE_TEXT", 0.85, "ARTICLE_STRUCTURE"))
        .otherwise(to("OUT_OF_SCOPE", 0.8, "NO_SUPPORTED_ROUTE"))
    )
