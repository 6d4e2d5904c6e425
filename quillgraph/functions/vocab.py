"""Language profiles: the word lists, tables and templates that the text and graph
operators work with. Profiles are data; any of them can be replaced field by field."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Profile:
    stop_words: tuple[str, ...] = ()
    list_markers: tuple[str, ...] = ()
    enumeration_markers: tuple[str, ...] = ()
    role_words: tuple[str, ...] = ()
    instruction_stems: tuple[str, ...] = ()
    #: (stem, plural label), in order: the first stem found in a question counts.
    roles: tuple[tuple[str, str], ...] = ()
    pronouns: tuple[str, ...] = ()
    negatives: tuple[str, ...] = ()
    #: (triggers, additions): stems that widen the search for the densest window.
    synonyms: tuple[tuple[tuple[str, ...], tuple[str, ...]], ...] = ()
    #: (triggers, section anchors), the first that fits.
    anchors: tuple[tuple[tuple[str, ...], tuple[str, ...]], ...] = ()
    #: (triggers, properties), the first that fits; else all_properties.
    properties: tuple[tuple[tuple[str, ...], tuple[str, ...]], ...] = ()
    all_properties: tuple[str, ...] = ()
    #: Infobox properties shown first, with their labels, in order.
    card: tuple[tuple[str, str], ...] = ()
    card_block: tuple[str, ...] = ()
    #: Infobox row labels of a property, in order.
    label_property: tuple[tuple[str, str], ...] = ()
    property_labels: tuple[tuple[str, str], ...] = ()
    #: {role}, {low} (role in lower case) and {entity}.
    role_templates: tuple[str, ...] = ()
    templates: tuple[str, ...] = ()
    list_templates: tuple[str, ...] = ()
    category_prefix: str = "Category:{role} {entity}"
    card_heading: str = "Card:"
    yes: str = "YES"
    no: tuple[str, ...] = ("NO",)
    directive: str = "search"
    predecessor: str = "Predecessor"
    office_labels: tuple[str, ...] = ()
    strings: dict[str, str] = field(default_factory=dict)


# The lists, labels and templates below must have exactly these entries in this order.
RU = Profile(
    stop_words=tuple(
        "что как кто где когда почему зачем какой какая какие это этот эта эти тот та то те ты вы мне тебе ему ей нам вам им "
        "знаешь знаете знает расскажи расскажите опиши опишите дай дайте напиши напишите пожалуйста "
        "про о об обо на в во у из из-за под над за по и а но или либо ни не же ли бы да нет "
        "есть был была было были буду будет будут его её их мой моя моё мои твой твоя твоё твои может могу можешь хочу хочешь "
        "перечисли перечислите назови назовите список спиши все всех весь вся всё всего "
        "последние последний последних последнее последней лет год года годов годы году сколько несколько каждый каждая также ещё еще "
        "what who where when why how is are was were the a an of on in at to for with and or tell me you about give please".split()
    ),
    list_markers=("перечисли", "перечислите", "список", "спиши", "спишите", "назови всех", "назовите всех", "все ", "всех ", "всю ", "какие ", "кто из"),
    enumeration_markers=("перечисл", "список", "все ", "всех", "назови", "по годам"),
    role_words=tuple("Мэр Мэры Глава Главы Президент Президенты Губернатор Губернаторы Министр Министры Король Короли Премьер Премьеры Депутат Депутаты Лидер Лидеры".split()),
    instruction_stems=tuple("перечисл назов расскаж опиш напиш скаж ответ покаж помог приведи приведит".split()),
    roles=(
        ("мэр", "Мэры"), ("глав", "Главы"), ("градонач", "Градоначальники"), ("руковод", "Руководители"), ("президент", "Президенты"),
        ("вице-президент", "Вице-президенты"), ("губернат", "Губернаторы"), ("министр", "Министры"), ("премьер", "Премьер-министры"),
        ("канцлер", "Канцлеры"), ("лидер", "Лидеры"), ("король", "Короли"), ("корол", "Короли"), ("император", "Императоры"), ("царь", "Цари"),
        ("хан", "Ханы"), ("султан", "Султаны"), ("папа", "Папы римские"), ("пап рим", "Папы римские"), ("патриарх", "Патриархи"),
        ("лауреат", "Лауреаты"), ("номинант", "Номинанты"), ("обладател", "Обладатели"), ("облада­тел", "Обладатели"),
        ("чемпион", "Чемпионы"), ("победител", "Победители"), ("призёр", "Призёры"), ("призер", "Призёры"), ("финалист", "Финалисты"),
        ("олимпийск", "Олимпийские чемпионы"), ("член", "Члены"), ("директор", "Директора"), ("ректор", "Ректоры"), ("редактор", "Редакторы"),
        ("режиссёр", "Режиссёры"), ("режиссер", "Режиссёры"), ("композитор", "Композиторы"), ("писател", "Писатели"), ("поэт", "Поэты"),
        ("учён", "Учёные"), ("учен", "Учёные"), ("космонавт", "Космонавты"), ("астронавт", "Астронавты"),
    ),
    pronouns=tuple("там тут здесь он она оно они его её ее их ему ей им этот эта это эти тот та те который которая которое которые".split()),
    negatives=("не подход", "не явля", "нет данных"),
    synonyms=(
        (("мэр", "глав", "градонач", "руковод", "губерн"), ("мэр", "глав", "градонач", "руковод")),
        (("лауреат", "обладат", "номинант"), ("лауреат", "обладат", "награж")),
        (("чемпион", "победит", "призёр", "призер", "финалист"), ("чемпион", "победит", "призёр", "финалист")),
        (("автор", "режисс", "сценарист", "продюсер", "композитор"), ("автор", "режисс", "сценарист", "продюсер")),
        (("отец", "мать", "сын", "дочь", "ребён", "ребен", "супруг", "брат", "сестр"), ("отец", "мать", "сын", "дочь", "супруг")),
    ),
    anchors=(
        (("мэр", "глав", "руковод", "градонач", "губерн"), ("городская власть", "главы города", "руководство", "руководители", "главы", "мэры", "градоначальники", "власти", "управление")),
        (("президент", "правительств"), ("президенты", "правительство", "главы государства", "руководство")),
        (("лауреат", "награ", "обладат", "медал"), ("награды", "лауреаты", "обладатели")),
        (("чемпион", "победит", "призёр"), ("чемпионы", "победители", "призёры")),
        (("режиссёр", "режиссер", "сценарист", "продюсер"), ("создатели", "съёмочная группа", "режиссёры")),
    ),
    properties=(
        (("мэр", "глава", "глав", "руковод", "градонач", "губерн", "президент", "министр", "канцлер", "лидер", "патриарх", "царь", "король", "корол", "хан", "султан", "император", "столица", "правлен", "власт"), ("P6", "P1365", "P1366")),
        (("отец", "мать", "сын", "дочь", "ребён", "ребен", "супруг", "жена", "муж", "брат", "сестр", "родствен", "семья"), ("P26", "P22", "P25", "P40", "P3373", "P1365", "P1366")),
        (("лауреат", "награ", "обладат", "номинант", "премия", "медал", "орден"), ("P166", "P39", "P1365", "P1366")),
        (("режиссёр", "режиссер", "сценарист", "продюсер", "автор", "исполнит", "композитор", "писател", "поэт", "фильм", "книг", "альбом", "сериал"), ("P50", "P57", "P58", "P162", "P175", "P800", "P1365", "P1366")),
        (("учён", "учен", "научн", "профессор", "академик", "доктор", "диссертац"), ("P184", "P802", "P39", "P166", "P1365", "P1366")),
    ),
    all_properties=("P6", "P1365", "P1366", "P39", "P166", "P26", "P40", "P22", "P25", "P3373", "P50", "P175", "P800", "P184", "P802", "P57", "P58", "P162", "P36", "P159", "P127", "P112"),
    card=(
        ("P6", "Глава/мэр"), ("P1082", "Население"), ("P2046", "Площадь"), ("P571", "Основан"), ("P17", "Страна"), ("P131", "Регион"), ("P36", "Столица"),
        ("P30", "Континент"), ("P38", "Валюта"), ("P122", "Форма правления"), ("P194", "Законодательный орган"), ("P159", "Штаб-квартира"), ("P421", "Часовой пояс"),
        ("P39", "Должность"), ("P569", "Дата рождения"), ("P570", "Дата смерти"), ("P19", "Место рождения"), ("P20", "Место смерти"), ("P102", "Партия"),
        ("P69", "Образование"), ("P106", "Род занятий"), ("P166", "Награды"), ("P184", "Научный руководитель"), ("P1365", "Предшественник"), ("P1366", "Преемник"),
        ("P26", "Супруг(а)"), ("P22", "Отец"), ("P25", "Мать"), ("P40", "Дети"), ("P50", "Автор"), ("P57", "Режиссёр"), ("P58", "Сценарист"),
        ("P175", "Исполнитель"), ("P162", "Продюсер"), ("P136", "Жанр"), ("P577", "Дата публикации"),
    ),
    card_block=("флаг", "герб", "гимн", "координат", "карта", "индекс", "телефонный", "почтов", "окато", "октмо", "идентификатор", "медиафайл", "викисклад", "аудио", "логотип", "изображени", "цифровой"),
    label_property=(
        ("глава", "P6"), ("мэр", "P6"), ("градоначальник", "P6"), ("предшественник", "P1365"), ("предыдущий", "P1365"), ("преемник", "P1366"), ("следующий", "P1366"),
        ("супруг", "P26"), ("супруга", "P26"), ("жена", "P26"), ("муж", "P26"), ("отец", "P22"), ("мать", "P25"), ("дети", "P40"), ("ребёнок", "P40"), ("ребенок", "P40"),
        ("автор", "P50"), ("авторы", "P50"), ("режиссёр", "P57"), ("режиссер", "P57"), ("сценарист", "P58"), ("продюсер", "P162"), ("исполнитель", "P175"),
        ("научный руководитель", "P184"), ("должность", "P39"), ("столица", "P36"), ("штаб-квартира", "P159"), ("владелец", "P127"), ("основатель", "P112"),
    ),
    property_labels=(
        ("P6", "глава"), ("P1365", "предшественник"), ("P1366", "преемник"), ("P39", "должность"), ("P166", "награда"), ("P26", "супруг"), ("P22", "отец"), ("P25", "мать"),
        ("P40", "ребёнок"), ("P3373", "брат/сестра"), ("P50", "автор"), ("P175", "исполнитель"), ("P800", "заметная работа"), ("P184", "научный руководитель"), ("P802", "студент"),
        ("P57", "режиссёр"), ("P58", "сценарист"), ("P162", "продюсер"), ("P36", "столица"), ("P159", "штаб-квартира"), ("P127", "владелец"), ("P112", "основатель"),
    ),
    role_templates=("{role} {entity}", "Список {low} {entity}", "Список {low} города {entity}", "Список {low} страны {entity}", "{role} {entity} по годам", "{role} по {entity}", "{role} {entity} (хронология)"),
    templates=("Главы {entity}", "Список глав {entity}", "Список глав города {entity}", "Мэры {entity}", "Список мэров {entity}", "Руководители {entity}", "Градоначальники {entity}", "История {entity}", "Хронология {entity}"),
    list_templates=("Градоначальники {entity}", "Главы {entity}", "Список глав {entity}", "Мэры {entity}", "Список мэров {entity}"),
    category_prefix="Категория:{role} {entity}",
    card_heading="Карточка:",
    yes="ДА",
    no=("НЕТ", "NO"),
    directive="поиск",
    predecessor="Предшественник",
    office_labels=("Глава/мэр", "Мэр", "Президент", "Губернатор", "Глава"),
    strings={"found": "найдено", "by": "по", "from": "из", "excerpts": "ВЫДЕРЖКИ", "question": "Вопрос"},
)

EN = Profile(
    stop_words=tuple("what who where when why how which is are was were be been the a an of on in at to for with and or not by from this that these those it its he she they his her their tell me you about give please list all every each".split()),
    list_markers=("list ", "name all", "all the ", "which ", "who were", "every "),
    enumeration_markers=("list ", "all ", "every ", "name ", "by year"),
    role_words=tuple("Mayor Mayors Head Heads President Presidents Governor Governors Minister Ministers King Kings Leader Leaders".split()),
    instruction_stems=("list", "name", "tell", "describe", "give", "show", "write"),
    roles=(("mayor", "Mayors"), ("president", "Presidents"), ("governor", "Governors"), ("minister", "Ministers"), ("king", "Kings"), ("winner", "Winners"), ("champion", "Champions"), ("author", "Authors"), ("director", "Directors")),
    pronouns=tuple("there here he she it they his her its their this that these those which whom".split()),
    negatives=("does not fit", "is not", "no data"),
    synonyms=((("mayor", "head", "govern"), ("mayor", "head", "govern")), (("winner", "laureate", "award"), ("winner", "laureate", "award"))),
    anchors=((("mayor", "head", "govern"), ("government", "mayors", "administration")), (("winner", "award", "laureate"), ("awards", "laureates"))),
    properties=RU.properties[:0],
    all_properties=RU.all_properties,
    card=(("P6", "Head"), ("P1082", "Population"), ("P2046", "Area"), ("P571", "Founded"), ("P17", "Country"), ("P39", "Office"), ("P569", "Born"), ("P570", "Died"), ("P1365", "Predecessor"), ("P1366", "Successor")),
    card_block=("flag", "coat of arms", "coordinates", "postal", "logo", "image"),
    label_property=(("head", "P6"), ("mayor", "P6"), ("predecessor", "P1365"), ("successor", "P1366"), ("spouse", "P26"), ("father", "P22"), ("mother", "P25"), ("author", "P50")),
    property_labels=(("P6", "head"), ("P1365", "predecessor"), ("P1366", "successor")),
    role_templates=("{role} of {entity}", "List of {low} of {entity}", "{role} of {entity} by year"),
    templates=("Heads of {entity}", "Mayors of {entity}", "History of {entity}", "Timeline of {entity}"),
    list_templates=("Heads of {entity}", "Mayors of {entity}"),
    office_labels=("Head", "Mayor", "President", "Governor"),
    strings={"found": "found", "by": "by", "from": "from", "excerpts": "EXCERPTS", "question": "Question"},
)
