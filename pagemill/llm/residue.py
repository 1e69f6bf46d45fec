"""Template residue: unfilled placeholders, filler text, error messages and script notices.

A grammar for each delimiter finds placeholders; what stands around a match decides whether it counts (code blocks and
text that explains a template syntax do not). Filler, errors and notices count only where they are the page: their
patterns are weighed against the length of the text that is left without them, whatever the page's length.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.rows import map_batches

MARKER = re.compile(r"<!--\s*page:.*?-->")
#: The converter's own results, which are no residue.
OWN_RESULTS = re.compile(r"\[空白页\]|\[图片识别失败\]|\[logo\]|\[装饰图片\]")

_FILL = r"(?:fill[ -]?in|to be (?:completed|supplied|confirmed|determined|added|filled)|insert|enter|your|add|choose|select|placeholder|tbd|tbc|todo|company name|client name|fund name|à compléter|à remplir|insérer|completar|rellenar|insertar|preencher|inserir|a definir|einfügen|ausfüllen|заполнить|вставить|укажите|待补充|待填|待定|待录入|待确认|待完善|请填写|请输入|请选择|此处填写|在此|点击输入|填写|插入|请插入|粘贴|入力してください|記入)"

#: Square brackets, for a character class.
_SQUARE = r"\[\]"


def _within(excluded: str) -> str:
    """A character of a paragraph but ``excluded``: a placeholder may go over a line end, not over a blank line."""
    return rf"(?:[^{excluded}\n]|\n(?![ \t]*\n))"


#: Delimiter-specific grammars. Each entry: name, pattern, whether prose around a match may explain it away.
PLACEHOLDERS = (
    ("double braces", re.compile(rf"\{{\{{{_within('{}')}+\}}\}}|\{{\{{{_within('')}+?\}}\}}"), True),
    ("statement braces", re.compile(rf"\{{%-?{_within('%')}+-?%\}}"), True),
    ("dollar braces", re.compile(r"[$#]\{[A-Za-z_][\w.\[\]\-]*\}"), True),
    ("dollar name", re.compile(r"(?<![\w$])\$[A-Za-z][A-Za-z_]*\$|(?<![\w$])\$[A-Za-z_]*_[A-Za-z_]+\b|(?<=[:：])\s*\$[A-Za-z]\w*[ \t]*$", re.M), True),
    ("percent name", re.compile(r"%%?[A-Z][A-Z]*(?:_[A-Z0-9]+)+%%?|%\([a-z_]+\)[sd]"), True),
    ("at name", re.compile(r"@@[A-Za-z_][\w.]*@@|__[A-Z][A-Z0-9_]*[A-Z0-9]__"), True),
    ("server tag", re.compile(rf"<%[=\-@#]?{_within('%')}+%>|<\?={_within('?')}+\?>"), True),
    ("angle name", re.compile(rf"<<{_within('<>')}+>>|««{_within('«»')}+»»"), True),
    ("angle field", re.compile(rf"<(?:enter|insert|your|fill|add|please|type|choose|select|placeholder|tbd|请|填|输入|待){_within('<>')}*>", re.I), True),
    ("square double", re.compile(rf"\[\[[A-Z][A-Z0-9 _\-]{{2,}}\]\]|\[\[{_within(_SQUARE)}*?(?:insert|fill|enter|请|待){_within(_SQUARE)}*\]\]", re.I), True),
    ("square field", re.compile(rf"\[\s*{_FILL}{_within(_SQUARE)}*\]|\[(?:TBD|TBC|TODO)\b{_within(_SQUARE)}*\]|\[(?:Company|Client|Fund|Issuer|Manager|Insert|Your|Nom|Nome|Nombre)[ _][A-Z][\w<>!: \-]*\]", re.I), True),
    ("lenticular field", re.compile(rf"[【〔［]\s*{_FILL}{_within('】〕］')}*[】〕］]", re.I), True),
    # round brackets hold sentences as well, which begin with such words too
    ("round field", re.compile(rf"[(（]\s*{_FILL}{_within('()（）.!?。！？')}*[)）]", re.I), True),
    ("numbered argument", re.compile(r"(?<![A-Za-z0-9_{\\$])\{\d{1,2}\}(?![A-Za-z0-9_}])"), True),
    ("serialised object", re.compile(r"\[object Object\]|\bundefined undefined\b|(?<=[:：] )(?:undefined|NaN|null)[ \t]*$", re.M), True),
    ("masked name", re.compile(r"(?<![A-Za-z0-9+/])[XＸ×]{3,}(?:有限公司|股份|公司|基金|[ _]?(?:Ltd|Inc|LLC|GmbH|SA|Company|Fund|Corp)\b)|(?<![A-Za-z0-9+/])X{2}/X{2}/(?:20)?X{2,4}|[某×Ｘ]{2,}年[某×Ｘ]{1,}月|20[XＸ×]{2}(?:年|\b)"), True),
    ("blank date", re.compile(r"[_＿]{2,}\s*年\s*[_＿]{1,}\s*月|[_＿]{1,4}/[_＿]{1,4}/[_＿]{2,4}"), False),
    ("pending image", re.compile(r"<!--\s*IMG_OCR:(?:[^>\n]*-->)?"), False),
    ("form blank", re.compile(r"(?:^|[:：])[ \t]*(?:_{3,}|＿{2,}|\.{6,}|…{3,})[ \t]*$|[_＿]{6,}", re.M), False),
    ("form box", re.compile(r"[:：][ \t]*(?:\[[ \t]*\]|【[ \t　]*】|（[ 　]*）|\([ \t]*\))[ \t]*$", re.M), False),
    ("form prompt", re.compile(r"[:：][ \t]*(?:请输入|请填写|请选择|待填|待补充|待定|待录入|N/?A[ \t]*[（(](?:待填|to be (?:filled|completed|added)|à compléter|por completar|a preencher)[）)]|to be (?:filled in|completed|confirmed|supplied)|TBD|TBC|TODO|click (?:or tap )?(?:here )?to enter text\.?|à compléter|por completar|a preencher)[ \t]*$", re.M | re.I), False),
)

#: Filler: repeated or telltale dummy text, matched at the start of a sentence; what follows in it may hold no figure.
FILLER = re.compile(
    r"(?:lorem ipsum\b|(?:(?:test|asdf|qwer|foo|bar|blah|xxx|dummy|sample|abc|测试|占位|テスト|тест|prueba|teste|essai)[ \t,.，。]*){2,}$"
    r"|(?:sample|dummy|placeholder|filler|body|example) (?:text|copy|content|paragraph)\b|your (?:heading|text|title|content|headline|logo)\b"
    r"|[^\n]*\b(?:copy|text|content) (?:to be|will be) (?:supplied|added|provided|inserted)\b|(?:replace|insert|add|type|enter) (?:this|your)\b[^\n]*\b(?:text|content|paragraph|heading|copy|here)\b"
    r"|(?:一二三四五六七八九十|甲乙丙丁戊己庚辛|一二三四五|a ?b ?c ?d ?e ?f ?g|qwerty(?:uiop)?|1234567890)+[ \t,.，。]*$|(?:click|tap) (?:here )?to (?:add|edit|enter)\b|[^\n，]*(?:正文|内容|标题|文字|段落)[^\n，]*(?:待录入|待补充|待填|占位|在此|预览)|在此(?:输入|添加|填写|处)|(?:这里|此处)(?:是|为)?(?:占位|示例|测试|填写)|请在此"
    r"|texte (?:d['’]exemple|à venir|fictif)\b|(?:texto|conteúdo|contenido) (?:de (?:exemplo|ejemplo|relleno)|provisório|a inserir|por insertar)\b|(?:Beispiel|Blind|Platzhalter)text\b|(?:пример текста|текст-заполнитель|здесь будет текст)|(?:ここに|ダミー)[^\n]*(?:入力|テキスト))",
    re.I,
)

#: Error messages: technical phrases that carry a page by themselves.
ERROR = re.compile(
    r"\b(?:HTTP\s*)?(?:Error|Erreur|Erro|Fehler|Ошибка|エラー|错误(?:代码|编号)?|HTTP|代码|コード)\s*[:：]?\s*#?[1-5]\d\d\b|\b[45]\d\d\s+(?:Not Found|Forbidden|Bad Gateway|Bad Request|Unauthorized|Internal|Service|Gateway|页面|错误)|\bERR_[A-Z_]{4,}|\bECONN[A-Z]+"
    r"|\b(?:page|file|document|resource) (?:not found|could not be found|does not exist|cannot be displayed|is unavailable|has (?:been )?(?:moved|removed|expired))|(?:file|page) you (?:asked for|requested)|\bpage introuvable|\bp[áa]gina no encontrada|\bp[áa]gina n[ãa]o encontrada|Seite (?:wurde )?nicht gefunden|страница не найдена|ページが見つかりません|(?:页面|文件|网页|内容)(?:不存在|未找到|无法(?:显示|访问|打开)|加载失败|已被(?:移除|删除)|走丢)"
    r"|\b(?:access|permission) (?:denied|forbidden)|\bacc[èe]s refus[ée]|\bacceso denegado|\bacesso negado|Zugriff verweigert|доступ (?:запрещ[её]н|закрыт)|アクセス(?:が)?(?:拒否|できません)|没有(?:访问|权限)|无权(?:访问|限)|访问(?:被拒绝|受限)|权限不足"
    r"|\b(?:session|sesi[óo]n|sess[ãa]o) (?:has |a |ha )?(?:expir|timed out)|session (?:expirée|a expiré)|Sitzung (?:ist )?abgelaufen|сессия истекла|(?:会话|登录|セッション)(?:已|が)?(?:过期|失效|超时|切れ)"
    r"|\b(?:service|server|servicio|servi[çc]o|serveur) (?:is )?(?:temporarily |currently |temporalmente |temporariamente |temporairement )?(?:unavailable|down|no disponible|indispon[íi]vel|indisponible)|(?:服务|系统|网站)(?:暂)?(?:不可用|繁忙|维护|异常)|サービス(?:は|が)?(?:一時的に)?(?:利用できません|停止)|сервис (?:временно )?недоступен"
    r"|\b(?:internal|unexpected|unknown|fatal) (?:server )?error\b|something went wrong|too many requests|\b(?:request|gateway|connection|upstream)[^\n]*(?:timed? ?out|could not be served|did not answer|failed|refused|reset)\b|请求(?:超时|过于频繁|失败|被拒)|(?:网络|连接)(?:超时|异常|错误|失败)|(?:加载|读取|下载|渲染)(?:失败|超时|出错)|请(?:稍后|刷新)[^\n]*(?:重试|再试)|délai d['’]attente|tiempo de espera|tempo (?:limite )?esgotado|\btry again later\b|\bretry later\b|réessayer|intente de nuevo|tente novamente"
    r"|\b\w*(?:Error|Exception): |\bTraceback \(most recent|^\s+at [\w.$<>]+ ?\([^)\n]*\)|\bstack trace\b|Warning: \w+\(\)|\bReference (?:#|no\.? ?)?[0-9a-f]{6,}\b|\bRay(?: ID)?: [0-9a-f]{6,}|请求号[:：]|错误编号",
    re.I | re.M,
)

#: Notices that scripts, cookies or a newer browser are needed.
SCRIPT = re.compile(
    r"<noscript\b|\b(?:enable|activate|allow|turn(?:ed)? (?:on|off)|requires?|need(?:s|ed)?(?: to)?(?: \w+){0,2}|disabled?|without|supports?)\b[^\n.]*\b(?:java ?script|scripts?\b|cookies)|\b(?:java ?script|scripts?|cookies)\b[^\n.]*\b(?:is|are|must be|to be|has been|need)?\s*(?:required|disabled|enabled|turned o(?:n|ff)|blocked|needed|not (?:supported|enabled|available))"
    r"|\b(?:activez|activer|active|ative|activar|ativar|habilite|habilitar|aktivieren Sie|autorisez|permita|permitir)\b[^\n.]*\b(?:java ?script|scripts?|cookies)|java ?script[^\n.]*(?:désactivé|requis|nécessaire|desactivado|desativado|necess[áa]rio|deaktiviert|erforderlich|отключ|необходим)|включите[^\n.]*(?:java ?script|скрипт)|(?:browser|navigateur|navegador|Browser|браузер)[^\n.]*(?:out of date|outdated|not supported|unsupported|too old|upgrade|update|obsolète|mettez à jour|desactualizad|actualice|atualize|veraltet|устарел|обновите)|(?:upgrade|update|mettez à jour|actualice|atualize|aktualisieren|обновите)[^\n.]*(?:browser|navigateur|navegador|браузер)|checking your browser|loading(?:…|\.\.\.)"
    r"|(?:启用|开启|打开|允许|支持|禁用|关闭)[^\n。]*(?:脚本|JavaScript|Cookie)|(?:脚本|JavaScript|Cookie)[^\n。]*(?:被?禁用|未启用|运行|不可用|关闭)|浏览器[^\n。]*(?:版本)?(?:过低|过旧|太旧|不支持|升级|更新)|(?:ブラウザ|スクリプト|JavaScript)[^\n。]*(?:有効|無効|更新|必要|対応していません)",
    re.I,
)

#: A quick look for each: small letters that no message is without.
_SCRIPT_SIGNS = ("script", "cookie", "browser", "navigateur", "navegador", "браузер", "скрипт", "浏览器", "脚本", "ブラウザ", "スクリプト", "loading")
_ERROR_SIGNS = (
    "error", "erreur", "erro", "fehler", "ошибка", "エラー", "错误", "http", "代码", "コード", "not found", "be found", "not exist", "cannot be", "forbidden", "bad gateway", "bad request", "unauthorized", "internal", "service", "gateway", "页面", "err_", "econn", "unavailable", "moved", "expire", "you asked", "you requested", "introuvable", "encontrada", "gefunden", "не найдена", "見つかりません",
    "不存在", "未找到", "无法", "加载", "已被", "走丢", "denied", "refus", "denegado", "negado", "verweigert", "доступ", "アクセス", "没有", "无权", "访问", "权限", "expir", "timed out", "abgelaufen", "истекла", "会话", "登录", "セッション", " down", "disponible", "indispon", "服务", "系统", "网站", "サービス", "недоступен", "went wrong", "too many", "time", "could not", "did not", "failed", "reset", "请求", "网络", "连接", "读取", "下载", "渲染", "请",
    "attente", "tiempo", "esgotado", "again later", "retry later", "réessayer", "intente", "tente", "exception", "traceback", "at ", "stack trace", "warning", "reference", "ray",
)


class Message(NamedTuple):
    """A kind of message: its name, its pattern, and the signs one of which every match has."""

    kind: str
    pattern: re.Pattern
    signs: tuple[str, ...]

    def search(self, text: str) -> bool:
        low = text.lower()
        return any(x in low for x in self.signs) and self.pattern.search(text) is not None


MESSAGES = (Message("script", SCRIPT, _SCRIPT_SIGNS), Message("error", ERROR, _ERROR_SIGNS))

#: Terms of template syntax: in the sentence of a match or the one before it they explain the match away.
ABOUT = re.compile(r"\b(?:template (?:engine|syntax|language|variable)s?|placeholders? (?:such as|like|are|is)|syntax|curly (?:braces|brackets)|tutorial|markup language|variables? (?:are|is|such as|like|in)|escap(?:e|ed|ing)|notation)\b|花括号|占位符|模板(?:语法|引擎|变量)|语法|教程|变量(?:形如|用|以)|标记变量|accolades|llaves|chaves|syntaxe|sintaxis|sintaxe|фигурн|波括弧|テンプレート", re.I)
#: Words that make what follows at once an example.
EXAMPLE = re.compile(r"(?:\b(?:e\.g\.|for example|for instance|such as|like|written|the (?:set|literal|string|token))|例如|形如|比如|诸如)[\s,:，：\"'“”「『‘’(（]*$", re.I)
#: Ends of sentences and paragraphs.
_STOP = re.compile(r"[.!?](?=\s)|[。！？]|\n[ \t]*(?=\n)")

_FENCE = re.compile(r"^(```|~~~)[^\n]*\n.*?(?:^\1[ \t]*$|\Z)", re.S | re.M)
_INLINE = re.compile(r"`[^`\n]+`")
_BLOB = re.compile(r"[A-Za-z0-9+/]{60,}")

#: A quick look that no residue passes: a literal of every grammar, then a pattern for those whose literals are common.
_LITERALS = ("{{", "{%", "${", "#{", "$", "@@", "__", "<%", "<?", "<<", "««", "[[", "＿", "IMG_OCR", "......", "……", "请", "待", "填", "输入", "插入", "粘贴", "记入", "記入", "undefined", "NaN", "null", "XX", "ＸＸ", "××", "某某")
_HINT = re.compile(r"%[A-Z(%]|<(?:enter|insert|your|fill|add|please|type|choose|select|placeholder|tbd)|\[\s*[\]A-Za-zÀ-ÿЀ-ӿ在入]|[(（【〔［]\s*(?:在此|入力|fill|to be|insert|enter|your|add|choose|select|placeholder|tbd|tbc|todo|company|client|fund|à |ins|compl|rellenar|preencher|a definir|ein|aus|запол|встав|укаж|N/A|[ \t　]*[）】)])|\{\d|[:：][ \t]*(?:N/A|NA[ \t]*[（(]|to be|TB[DC]|TODO|click|à |por |a |[(（【])", re.I)


def _may_hold(text: str) -> bool:
    return any(x in text for x in _LITERALS) or _HINT.search(text) is not None


#: Share of a page's letters that filler must make up, and share of its sentences that messages must.
SHARE, THIRD = 0.6, 1 / 3
_SENTENCE = re.compile(r"(?<=[.!?]) +|(?<=[。！？])")
_FIGURE = re.compile(r"\d")
#: A line of a stack trace below its message.
_FRAME = re.compile(r'^[ \t]*(?:at [\w.$<>/]+ ?\([^)\n]*\)|File "[^"\n]+", line \d+|\.\.\. \d+ more$|Caused by: )', re.M)
#: Something counted: a sentence that does so tells of errors, it is none. Codes and waiting times are not counts.
_COUNT = re.compile(r"(?<![\w#:.\-/])(?!(?:[1-5]\d\d)\b)\d[\d.,]*(?:[ -]+(?!(?:seconds?|minutes?|hours?|ms|secondes?|segundos?|minutos?|минут|секунд|s)\b)[a-zà-ÿа-яё][\w\-]{2,}|[次家个件位名笔项])")
#: Report text beside a message: a table row, or a line of prose with figures.
_TABLE_ROW = re.compile(r"\|[^|\n]*\|[^|\n]*\|")


def _explained(text: str, a: int, b: int) -> bool:
    """Whether the words around ``text[a:b]`` speak about it: an example is announced right before it, or syntax is the topic of its sentence or the one before."""
    lo = text.rfind("\n\n", 0, a) + 1
    before = text[lo:a]
    if EXAMPLE.search(before):
        return True
    ends = [m.end() for m in _STOP.finditer(before)]
    end = _STOP.search(text, b)
    return ABOUT.search(before[ends[-2] if len(ends) > 1 else 0 :] + " " + text[b : end.start() if end else len(text)]) is not None


def placeholders(text: str) -> list[tuple[str, int, int]]:
    """``(grammar, start, end)`` of the placeholders in ``text`` that nothing explains away."""
    if not _may_hold(text):
        return []
    code = None
    found = []
    for name, pattern, may in PLACEHOLDERS:
        for m in pattern.finditer(text):
            a, b = m.span()
            if code is None:
                code = [x.span() for skip in (_FENCE, _INLINE, _BLOB, OWN_RESULTS) for x in skip.finditer(text)]
            if a == b or any(x <= a < y for x, y in code) or may and _explained(text, a, b):
                continue
            found.append((name, a, b))
    return found


def _letters(s: str) -> int:
    return len(s) - s.count(" ") - s.count("\n")


def _pseudo_latin(body: str) -> bool:
    """Filler of a made-up tongue: several sentences drawn from a few words only, in no order, without one digit or function word."""
    if _FIGURE.search(body):
        return False
    words = re.findall(r"[^\W\d_]+", body.lower())
    if len(words) < 12 or any(ord(c) > 0x24F for w in words for c in w):
        return False
    kinds = set(words)
    if kinds & _COMMON:
        return False
    return len(kinds) <= max(12, len(words) * 0.6) and min(map(len, kinds)) > 2


_COMMON = frozenset("the of and to in a is for on with that by this de la le les des et du en un une el los las y que del der die das und von zu mit den im o os da do dos e em para com não se por au aux est il al su per".split())


def classify(text: str | None) -> tuple[str | None, list[tuple[str, int, int]]]:
    """Kind of residue of a page (``placeholder``, ``filler``, ``error``, ``script``) or None, with its placeholders."""
    if not text or not text.strip():
        return None, []
    found = placeholders(text)
    body = OWN_RESULTS.sub("", MARKER.sub("", text)).strip()
    if not body:
        return ("placeholder", found) if found else (None, [])
    lines = [l.strip(" \t#>*-•") for l in body.split("\n") if l.strip()]
    if _all_filler(lines, body):
        return "filler", found
    traced = _FRAME.search(body) is not None
    report = sorted((l for l in lines if _TABLE_ROW.search(l) or _reports(l)), key=len)
    for message in MESSAGES:
        # most often the first line that reports figures and is no message settles it
        if (traced or all(map(message.search, report))) and _is_message(message, body, traced):
            return message.kind, found
    return ("placeholder", found) if found else (None, [])


def _is_message(message: Message, body: str, traced: bool) -> bool:
    """Whether ``body`` is a message: a third of its sentences or of its letters are, and nothing beside them reports figures.

    Frames of a stack trace, and the code below each, are part of it.
    """
    hits = others = hit_letters = other_letters = told = 0
    code = False
    for raw in body.split("\n"):
        l = raw.strip(" \t#>*-•")
        if not l:
            continue
        if traced:
            if _FRAME.match(raw) or code and raw[:1] in " \t":
                hits, hit_letters = hits + 1, hit_letters + len(l)
                code = raw.lstrip().startswith("File ")
                continue
            code = False
        for x in _SENTENCE.split(l):
            if message.search(x):
                if _COUNT.search(x):
                    return False
                told, hits, hit_letters = told + 1, hits + 1, hit_letters + len(x)
            elif x.strip():
                if _TABLE_ROW.search(x) or _reports(x):
                    return False
                others, other_letters = others + 1, other_letters + len(x)
    return told > 0 and (hits >= THIRD * (hits + others) or hit_letters >= THIRD * (hit_letters + other_letters))


def _reports(sentence: str) -> bool:
    """Whether a sentence that is no message gives figures as a report does: it counts something, or is long beside its figures."""
    return _FIGURE.search(sentence) is not None and (len(sentence) > 50 or _COUNT.search(sentence) is not None)


def _all_filler(lines: list[str], body: str) -> bool:
    """Whether filler makes up ``SHARE`` of the letters; stops as soon as other sentences exceed the rest."""
    if re.match(r"\W*lorem ipsum\b", body, re.I) or _pseudo_latin(body):
        return True
    if len(lines) >= 2 and len(set(lines)) == 1 and _letters(lines[0]) and not _FIGURE.search(lines[0]):
        return True
    allowed = (1 - SHARE) * _letters(body)
    for line in sorted(lines, key=len, reverse=True):
        for x in _SENTENCE.split(line):
            m = FILLER.match(x)
            if not m or _FIGURE.search(x, m.end()):
                allowed -= _letters(x)
                if allowed < 0:
                    return False
    return _letters(body) > 0


def find_residue(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, kind, placeholders, first`` of the rows whose text is residue or holds a placeholder.

    ``placeholders`` counts them and ``first`` is the first one. Defined cases: NULL and empty texts and the converter's
    own results for blank pages and failed images are no residue; very long texts are scanned whole for placeholders;
    repeated rows come out repeated; extra columns are not read.
    """

    def make():
        def fn(cols):
            out = [[], [], [], []]
            for k, t in zip(*cols):
                kind, found = classify(t)
                if kind:
                    first = min(found, key=lambda f: f[1], default=None)
                    for col, v in zip(out, (k, kind, len(found), t[first[1] : first[2]] if first else None)):
                        col.append(v)
            return out

        return fn

    kind = df.schema[key].dataType.simpleString()
    return map_batches(df.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("t").isNotNull()), make, f"`{key}` {kind}, kind string, placeholders int, first string")


def without_residue(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows of ``df`` that are no residue, each row once as it came; rows with a NULL key or text stay."""
    gone = find_residue(df.where(F.col(key).isNotNull()), key, text).select(F.col(key).alias("__gone")).distinct()
    return df.join(gone, df[key] == F.col("__gone"), "left_anti")
