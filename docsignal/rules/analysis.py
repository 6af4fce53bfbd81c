"""The whole analysis of a document: facts, topic, type, level, guard and the texts that explain them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import facts
from ..session import cut
from . import levels, topics

#: Topics by stems, where no family holds; the stem of processing does not count in texts about fish: fixed values.
STEMS = (
    ("молоч", "Молочное животноводство"), ("семен", "Элитное семеноводство"), ("экспорт", "Экспорт АПК"), ("зернов", "Производство и реализация зерновых культур"),
    ("переработ", "Переработка сельхозпродукции"), ("субсид", "Господдержка и субсидии"), ("кредит", "Льготное кредитование АПК"), ("финансирован", "Финансирование АПК"),
)
FISH, PROCESSING, SECTOR, GENERAL = ("рыбопереработ", "рыбохозяй", "рыболов"), "переработ", ("апк", "сельск"), "Общий мониторинг АПК"
#: Texts of impact, by name; {topic} and {deadline} are put in: fixed values.
IMPACT = {
    "inactive": "Материал носит справочный характер: мера сейчас неактивна, поэтому его стоит использовать для истории условий и сравнения с будущими перезапусками.",
    "closed_dated": "Окно подачи уже завершено; документ полезен как справка по прошедшему отбору и для проверки условий перед следующим запуском.",
    "closed": "Прием заявок завершен; документ полезен как справка и ориентир для следующих отборов.",
    "discussed": "Есть действующий срок публичного обсуждения ({deadline}); GR-команде стоит проверить проект НПА и возможную позицию.",
    "open_dated": "Есть действующий срок подачи ({deadline}); GR-команде стоит проверить окно участия, условия меры и ответственных.",
    "open": "Прием заявок открыт; GR-команде стоит проверить условия участия, состав документов и ближайшие действия по мере.",
    "regular": "Мера действует на регулярной основе без разового дедлайна; ее можно использовать для проработки участия, сверки условий и планирования финансирования.",
    "urgent_topic": "Материал требует реакции GR-команды по теме «{topic}»: в тексте есть признаки мер поддержки, регуляторных изменений, сроков подачи или иных условий, которые могут потребовать действия.",
    "urgent": "Материал требует реакции GR-команды: в тексте есть признаки мер поддержки, регуляторных изменений, сроков подачи или иных условий, которые могут потребовать действия.",
    "watched": "Документ стоит держать на наблюдении: тема может затронуть АПК, регионы присутствия или профильные направления холдинга по направлению {topic}.",
    "background": "Документ относится к отраслевому фону и полезен для архива мониторинга, но не требует показа в ежедневной сводке.",
    "default": "Документ не относится к GR-задаче и не должен попадать в ежедневную сводку.",
}
#: Texts of reasons, likewise; {markers}, {more}, {topic} and {signal} are put in: fixed values.
REASON = {
    "service": "Документ похож на служебную, навигационную или нерелевантную страницу и не содержит признаков действия для GR.",
    "listing": "Страница распознана как справочная, категорийная или архивная, поэтому не может быть повышена выше watchlist даже при наличии слов про субсидии, отборы или постановления.",
    "closed": "В тексте найден признак завершенного приема заявок или отбора, поэтому документ не требует срочной реакции.",
    "inactive": "Мера поддержки распознана как неактивная, поэтому документ остается в справочном или наблюдаемом блоке.",
    "irrelevant": "Документ не содержит достаточно признаков отраслевого контекста или действия для GR и исключен из ежедневной сводки.",
    "background": "Документ содержит общий отраслевой контекст, но без признаков мер поддержки, сроков, отборов или регуляторного действия.",
    "watchlist": "Документ отнесен в watchlist: он связан с АПК или регионами присутствия, но без прямого сигнала к действию. Маркеры: {markers}. Бизнес-сигнал: {signal}.",
    "default": "Документ требует внимания GR, потому что содержит конкретный action-сигнал для АПК и интересов агрохолдинга: {markers}.{topic} Бизнес-сигнал: {signal}.",
}
NO_SIGNAL, COMMON_MARKERS, ACTION_MARKERS, SHOWN = "не выделен", "общие отраслевые маркеры", "действие в сфере АПК", 5
#: Marks of a discussion in a deadline: the stages of levels.
STAGES = "discussion_stage"


def topic_label(family_label: Column, text: Column) -> Column:
    """The family's label, else by stems, else the general one where the sector is named, else null. text is lower case."""
    has = lambda c, m: F.contains(c, F.lit(m))
    fish = F.exists(F.array(*map(F.lit, FISH)), lambda m: has(text, m))
    bare = F.when(fish, F.replace(text, F.lit(PROCESSING), F.lit(""))).otherwise(text)
    out = F.when(family_label.isNotNull(), family_label)
    for stem, label in STEMS:
        out = out.when(has(bare, stem), label)
    return out.when(F.exists(F.array(*map(F.lit, SECTOR)), lambda m: has(bare, m)), GENERAL)


def chosen(texts: Mapping[str, str], **when: Column) -> Column:
    """The text of the first name whose condition holds, in the order given, else the default."""
    out = None
    for name, condition in when.items():
        out = F.when(condition, texts[name]) if out is None else out.when(condition, texts[name])
    return out.otherwise(texts["default"])


def filled(out: Column, **parts: Column) -> Column:
    """A text with its parts put in."""
    for key, value in parts.items():
        out = F.replace(out, F.lit(f"{{{key}}}"), F.coalesce(value, F.lit("")))
    return out


def impact(level: Column, topic: Column, support: Column, application: Column, deadline: Column) -> Column:
    stages = levels.vocabulary()[STAGES]
    discussed = F.exists(F.array(*map(F.lit, stages)), lambda m: F.contains(F.lower(deadline), m))
    dated = F.coalesce(deadline != "", F.lit(False))
    text = chosen(
        IMPACT, inactive=support == "inactive", closed_dated=(application == "closed") & dated, closed=application == "closed", discussed=(application == "open") & dated & discussed, open_dated=(application == "open") & dated,
        open=application == "open", regular=(support == "active") & (application == "regular"), urgent_topic=(level == "requires_attention") & topic.isNotNull(), urgent=level == "requires_attention", watched=level == "watchlist", background=level == "background",
    )
    return filled(text, topic=F.coalesce(topic, F.lit("АПК")), deadline=deadline)


def reason(level: Column, topic: Column, page_type: Column, service: Column, support: Column, application: Column, hits: Column, signal: Column) -> Column:
    listing = page_type.isin("results_protocol", "registry", "reference_page", "section_page", "category_page", "year_archive")
    text = chosen(
        REASON, service=service | (page_type == "navigation"), listing=listing, closed=application == "closed", inactive=support == "inactive", irrelevant=level == "irrelevant", background=level == "background", watchlist=level == "watchlist",
    )
    shown = F.nullif(F.array_join(F.slice(hits, 1, SHOWN), ", "), F.lit(""))
    markers = F.coalesce(shown, F.when(level == "watchlist", COMMON_MARKERS).otherwise(ACTION_MARKERS))
    return filled(text, markers=markers, topic=F.when(topic.isNotNull(), F.concat(F.lit(" Тема: "), topic, F.lit("."))), signal=F.coalesce(F.nullif(signal, F.lit("")), F.lit(NO_SIGNAL)))


def analysed(df: DataFrame, as_of: str, keywords: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """df (title, raw_text, source_name, source_role, url, level, region, content_quality, is_service_page) with the analysis' columns.

    The order is the meaning: facts, topic, type and level, impact, the guard over that level, the impact of
    what it left, the reason. keywords: by group; the package's own if none are given. A null or empty text
    gives an analysis of the title.
    """
    keywords = topics.keyword_groups() if keywords is None else keywords
    lacks = [c for c in levels.INPUTS if c not in df.columns and c not in ("deadline_text", "deadline_date", "discussion_date", "application_status", "support_status")]
    df = df.withColumns({c: F.lit(None).cast(levels.INPUTS[c]) for c in lacks})
    told = facts.facts(F.concat_ws(" ", "title", "raw_text"), F.to_date(F.lit(as_of)))
    df = df.withColumn("facts", told).withColumns({c: F.col(f"facts.{c}") for c in ("deadline_text", "application_status", "support_status")})
    df = df.withColumns({"deadline_date": levels.dates.parse_deadline(F.col("deadline_text")), "discussion_date": levels.dates.regulation_deadline(F.col("deadline_text"))})
    # the plans of facts and of levels are each large enough for the optimizer
    df = cut(topics.with_topic(df, F.col("title"), F.col("raw_text"), name="topic_match"))
    df = cut(levels.leveled(df, as_of, keywords))
    label = topic_label(F.col("topic_match.label"), F.lower(F.concat_ws("\n", "title", "raw_text")))
    of = lambda: impact(F.col("action_level"), F.col("topic"), F.col("support_status"), F.col("application_status"), F.col("deadline_text"))
    df = df.withColumn("topic", label).withColumn("impact", of())
    # the guard reads what the analysis wrote, not the text
    known = {c: F.col(c) for c in ("title", "raw_text") if c in df.columns}
    df = df.withColumns({f"_{c}": v for c, v in known.items()} | {c: F.lit("") for c in ("title", "raw_text", "summary", "reason")} | {"signal": F.col("business_signal")})
    df = levels.guarded(df).withColumns({c: F.col(f"_{c}") for c in known}).drop(*(f"_{c}" for c in known), "summary", "signal")
    df = df.withColumn("impact", of())
    service = F.coalesce(F.col("is_service_page"), F.lit(False)) | (F.coalesce(F.col("content_quality"), F.lit("")) == "navigation")
    why = reason(F.col("action_level"), F.col("topic"), F.col("page_type"), service, F.col("support_status"), F.col("application_status"), F.col("matched_keywords"), F.col("business_signal"))
    return df.withColumns({"reason": why, "importance": levels.importance(F.col("action_level")), "is_relevant": F.col("action_level") != "irrelevant"})
