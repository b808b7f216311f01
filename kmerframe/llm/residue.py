"""Problem 8: documents that hold template residue, filler, an error page or a script notice in place of content.

A document is read as cells (text, code, output) in whichever written form it has:

* Slots. A grammar per delimiter finds unfilled slots: certain ones (`{{ a.b | f }}`, `{% x %}`, `<%= @x %>`, `${x}`, `@@x@@`, ...) and
  likely ones, whose signs have other uses (`{x}`, `[[x]]`, `<x>`, `[X]`, ...). A slot counts as a whole title or as the whole value
  behind a key. In running text the density decides: certain slots must take an eighth of the paragraph or come twice in it, likely ones
  two fifths of it. Inline code, formulas, code cells and outputs are left out, and so are paragraphs whose words tell
  that they are about templates, syntax or types. A likely slot must be named like a field of a form.
* Prompts. Instructions to the author in text, and exercise stubs in code that still have no answer.
* Filler. A few words over and over; words typed from one row of the keyboard; pseudo-words: running
  text without any short word in which long words keep coming back, which no language does; named filler phrases; headings whose
  content is still to come. A line in a language that is not known here is no filler by itself.
* Error pages and notices. Told by structure, not by sentence: without title, menu, footer and trace the text is short, there is no code,
  nothing in it tells of data or lessons, and its sentences join a thing (script, cookie, session, page, server, access, ...) with what is
  the matter with it (must be enabled, expired, not found, denied, ...), or give a status code. Words of fourteen languages.

Every document is judged whole, on its own, where it is read: no shuffle, no state, no limit on length or lines.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerframe.runtime import spread

#: An error page or notice, without title, menu, footer and trace, has at most so many words (characters where words are not spaced).
NOTICE_WORDS, NOTICE_CHARS = 70, 480
#: Words of a line that repeats itself, and of pseudo-words in a document, at least.
REPEATED_WORDS, PSEUDO_WORDS = 8, 10
#: Share of a paragraph that slots take.
CERTAIN_SHARE, LIKELY_SHARE = 1 / 8, 2 / 5
STUB_LINES = 2

_ID = r"[^\W\d]\w*(?:(?:[ _-]|\.)\w+){0,5}"
_ASK = r"(?:your|insert|add|fill[ -]in|enter|type|put|paste|choose|insertar?|inserir|añad[ae]r?|adicion\w+|preench\w+|rellen\w+|ihre?n?|dein|votre|vos|su|seu|sua|tu|ajoute[rz]?|einfügen|eintragen|inserisci|vostro|uw|jouw|vul|wpisz|wstaw|введите|вставьте|ваше?)"
_CERTAIN = (
    rf"\{{\{{\{{?[#/^&>!~-]?\s*{_ID}(?:\s*\|\s*{_ID}(?:\([^(){{}}\n]{{0,40}}\))?)*\s*-?\}}?\}}\}}", r"\{%-?\s*[^\W\d][^%{}\n]{0,60}%\}", r"<%[=-]?\s*@?[^\W\d][^%<>\n]{0,60}%>",
    rf"\$\{{\s*{_ID}\s*\}}", rf"#\{{\s*{_ID}\s*\}}", rf"%\({_ID}\)[sdf]", rf"@@{_ID}@@", r"(?<!\w)__(?-i:[A-ZÀ-Þ][A-ZÀ-Þ0-9]*(?:_[A-ZÀ-Þ0-9]+)*)__(?!\w)", r"\bXX_\w+?_XX\b",
    rf"<<{_ID}>>", rf"&lt;{_ID}&gt;", rf"<{_ASK} {_ID}>", rf"[\[［【]{_ASK}\b[^\]\n]{{0,60}}[\]］】](?!\()", r"(?-i:\b(?:INSERT|ENTER|ADD|TYPE|PUT|PASTE|WRITE)(?: [A-Z]+){1,5} HERE\b)",
)
_LIKELY = (
    rf"(?<![\w\\{{$#])\{{\s*{_ID}\s*\}}(?!\}})", r"%(?-i:[A-ZÀ-Þ][A-ZÀ-Þ0-9_]{2,})%", rf"\[\[{_ID}\]\]", rf"«\s?{_ID}\s?»", rf"(?<![\w<])<{_ID}>(?!>)", r"(?<!\w)__[^\W\d_]\w*?__(?!\w)",
    r"(?<![\w\]!\[])\[(?-i:[A-ZÀ-Þ])[\w /-]{1,30}\](?![(\[:\]])",
)
_TAGS = r"</?(?:table|thead|tbody|tr|td|th|html|head|title|body|center|div|span|p|b|i|em|strong|br|hr|img|a|ul|ol|li|pre|code|sub|sup|h\d|noscript|details|summary|font|iframe|style|script|svg|u|s|kbd|small|big|main|nav|section|header|footer)\b[^<>]*>"

_ANY_CERTAIN, _ANY = "(?:" + "|".join(_CERTAIN) + ")", "(?:" + "|".join(_CERTAIN + _LIKELY) + ")"
CERTAIN, LIKELY, ANY = (re.compile(x, re.I) for x in (_ANY_CERTAIN, "(?:" + "|".join(_LIKELY) + ")", _ANY))
TAG = re.compile(_TAGS, re.I)
TITLE = re.compile(rf"^(?:#{{1,6}}|=+)\s*{_ANY}\s*=*$", re.I)
KEYED = re.compile(rf"^(?:[-*+]\s+)?[*_]{{0,2}}[^\W\d][\w ()/-]{{0,30}}[*_]{{0,2}}\s*[:：][*_]{{0,2}}\s*{_ANY}(?:\s*[,;/]?\s*{_ANY})*\s*[.;]?$", re.I)
QUOTED = re.compile(r"``[^`]*``|`[^`\n]*`|\$\$.*?\$\$|\$(?!\{)[^$\n]*\$(?!\{)|(?<=[\s(=,])'[^'\n]*'|(?<=[\s(=,])\"[^\"\n]*\"")
SLOT_SIGNS = re.compile(r"[{}<>@%«\[［【]|__|XX_|&lt;| HERE\b")
#: Words of paragraphs that are about templates, markup or types.
ABOUT = re.compile(
    r"(?i)\b(?:templat\w*|placeholders?|jinja2?|mustache|handlebars|liquid|erb|cookiecutter|render\w*|interpolat\w*|syntax|escap\w+|braces?|brackets?|delimiters?|variables?|macros?|f-?strings?|format(?:ted|ting)? strings?|substitut\w+|replaces?|expands?|expan\w+|generics?|types?|operators?|methods?|dunder\w*|attributes?|regex\w*|patterns?|markup|wiki\w*|latex|shell|environment"
    r"|vorlagen?|platzhalter\w*|schablone\w*|syntaktisch\w*|klammern?|gabarits?|modèles?|accolades?|balises?|plantillas?|marcador\w*|llaves|modelos?|marcadores|chaves|segnaposto|modell[oi]|graffe|sjabloon|sjablonen|szablon\w*|znacznik\w*|şablon\w*)\b|шаблон|заполнител|скобк|テンプレート|構文|模板|占位符|语法"
)
#: Names that fields of forms have. Fixed values.
FIELD = re.compile(
    r"(?i)_|\b(?:(?:first|last|full|user|file|course|company|customer|student|team|project)[ -]?names?|names?|titles?|subtitle|authors?|dates?|years?|months?|weeks?|day|time|emails?|e-mail|phone|address|city|country|numbers?|ids?|slug|summary|abstract|descriptions?|objectives?|goals?|topics?|subjects?|courses?|sections?|chapters?|teams?|groups?|projects?|contacts?|licen[sc]es?|versions?|keywords?|data ?sources?|datasets?|instructors?|teachers?|students?|institutions?|organi[sz]ations?|companies|company|customers?|products?|prices?|amounts?|url|links?|text|content|body|value|placeholder|department|university|school"
    r"|kurs|datum|titel|autor\w*|thema|jahr|nachname|vorname|auteurs?|titre|nom|prénom|année|cours|fecha|título|nombre|curso|año|alumn\w|data|nome|ano|aluno|titolo|autore|anno|corso|naam|jaar|vak|imię|nazwisko|tytuł|rok)\b|имя|дата|тема|автор|氏名|名前|日付|题目|姓名|日期|标题"
)
#: A likely slot that is the whole of a title or value needs no field's name if it is one word in lower case.
PLAIN_NAME = re.compile(r"(?:\[\[|\{)\s*[a-zß-ÿа-я]\w*\s*(?:\]\]|\})")
DUNDER = frozenset("init eq ne lt le gt ge hash str repr call len iter next name main doc dict class file all new del add sub mul enter exit getitem setitem getattr setattr slots version future module bool contains path author".split())

PROMPTS = re.compile(
    r"""(?xi)
    \b(?:write|type|enter|put)\ your\ (?:answer|response|text|name|solution|explanation)\b.{0,40}\bhere
    | \byour\ (?:answer|explanation|text|response|analysis|comments?)\ goes\ here
    | \b(?:section|chapter)?\s*(?:heading|title|text|content|caption)\ goes\ here
    | \bclick\ here\ to\ add\b | \bdouble[- ]click\ to\ edit\b | ^add\ a\ (?:caption|title|description)\ (?:for|to)\b
    | \breplace\ this\ (?:text|line|paragraph|section|cell)\ (?:with|by)\b | \(?\bdelete\ this\ (?:line|text|cell|section)\b
    | \binstructions?\ (?:to|for)\ (?:the\ )?authors?\b | \bremove\ before\ publishing\b
    | \[\s*students?\s*:[^\]]*\] | \[?\bfill\ in\ (?:your|the|this)\b.{0,40}\bhere\b
    | \bhier\ (?:ihre|deine|die)\ (?:antwort|lösung)\b.{0,30}\b(?:eintragen|einfügen|schreiben) | \bzum\ bearbeiten\ doppelklicken | \bdiesen\ text\ durch\b.{0,60}\bersetzen
    | \b(?:écrivez|écrire|saisissez|inscrivez)\b.{0,20}\b(?:votre|la)\ réponse\b | \b(?:double[- ]cliquez|cliquez\ deux\ fois)\ pour\ (?:modifier|éditer) | \bremplace[rz]\ ce\ texte\ par\b
    | \bescrib[ae]\b.{0,20}\b(?:su|tu|la)\ respuesta\b | \bhaga\ doble\ clic\ para\ (?:editar|modificar) | \b(?:doble\ clic|pulse\ dos\ veces|haz\ doble\ clic)\ para\ editar | \b(?:sustituya|reemplace|sustituye|reemplaza)\ este\ texto\ por\b
    | \bescreva\b.{0,20}\b(?:sua|a)\ resposta\b | \bclique\ duas\ vezes\ para\ editar | \b(?:substitua|troque)\ este\ texto\ por\b
    """
)
CODE_PROMPTS = re.compile(
    r"""(?xim)
    ^[ \t]*(?:\#|//|%)+[ \t]*(?:your\ code\ (?:here|goes\ here)|<\s*your\ code[^>\n]*>|write\ your\ (?:code|solution|answer)[^\n]*|replace\ none\ with\ your\ (?:solution|answer|code)[^\n]*|insert\ your\ code[^\n]*|todo:?\ your\ code[^\n]*|fill\ in\ your\ code[^\n]*)
        \s*(?:\n\s*)*(?:(?:raise\ NotImplementedError\b.*|pass|\.\.\.|(?:\w+\s*(?:=|<-)\s*)?(?:None|NULL|nothing|NA)|return\ None|stop\(.*)\s*(?=\n|\Z)|\Z)
    | (?:=|<-|\()[ \t]*_{3,}[ \t]*(?:\#|//|\)|,|$)
    | (?:\#|//)[^\n]*\bfill\ in\ the\ blanks?\b
    | ^[ \t]*(?:\#|//)+[ \t]*BEGIN\ (?:ANSWER|SOLUTION|YOUR\ CODE)\b[^\n]*\n\s*(?:\#|//)+[ \t]*END\ (?:ANSWER|SOLUTION|YOUR\ CODE)\b
    """
)
MORE_PROMPTS = re.compile(
    r"""(?xi)
    \b(?:type|write|enter|put|paste|insert|add)\ (?:your\ |the\ |some\ |a\ )?(?:\w+\ ){0,3}?here\b(?!\ (?:are|is|we)) | \bedit\ this\ (?:cell|text|paragraph)\b | \byour\ (?:name|text|title|answer)\ here\b
    | \bscriv(?:i|ete|ere)\ qui\b | \binserisci\ qui\b | \bscrivi\b.{0,20}\btua\ risposta\b | \bfai\ doppio\ clic\ per\ modificare\b | \b(?:vul|typ|schrijf)\ hier\b.{0,30}\b(?:in|antwoord|tekst)\b | \bdubbelklik\ om\ te\ bewerken\b
    | \b(?:wpisz|wstaw|napisz)\ (?:tutaj|tu|swoj\w+|odpowiedź)\b | \bkliknij\ dwukrotnie\b.{0,20}\bedytować\b | \b(?:введите|напишите|вставьте)\ (?:здесь|сюда|свой|ваш|текст|ответ)\w* | ここに.{0,12}(?:入力|記入|書いて|追加) | (?:请)?在(?:此|这里|此处).{0,6}(?:输入|填写|写下|添加)
    | \bskriv\ (?:ditt\ svar|din\ text)\ här\b | \bcevabınızı\ buraya\ yazın\b | 여기에.{0,12}(?:입력|작성)
    """
)
#: Phrases that stand for text to be written. Fixed values.
FILLER = re.compile(
    r"(?i)\bfiller (?:paragraph|text|copy|content)\b|\b(?:placeholder|dummy|sample) (?:copy|content|paragraph|text)\b|\bplatzhaltertext\b|\bblindtext\b|\btexto de relleno\b|\btexte? de remplissage\b|\bfaux[- ]texte\b|\btexto (?:provisório|de preenchimento)\b|\btesto (?:segnaposto|di riempimento)\b|\b(?:opvul|vul)tekst\b|\btekst zastępczy\b|\bтекст[- ](?:рыба|заполнитель)\b|ダミーテキスト|占位文[字本]|\blorem ipsum\b|\bdolor sit amet\b|\bconsectetur adipisc"
)
STUB = re.compile(r"^(?:[-*+]\s+|#+\s*)?[^\W\d][\w #]{0,24}:\s*(?:tbd|tba|n/a(?: yet)?|x{3,}|to come|to follow|\.{3}|…|todo|pending)\.?$", re.I)
#: Lower-case pieces of which every match of the patterns above has one; a search for them is much cheaper than the patterns.
PROMPT_KEYS = (" here", "to edit", "edit this", "add a ", "replace this", "delete this", "author", "before publishing", "student", "fill in", "hier", "bearbeiten", "diesen text", "réponse", "cliquez", "ce texte", "respuesta", "clic", "dos veces", "este texto", "resposta", "duas vezes",
               " qui", "risposta", "dubbelklik", "wpisz", "wstaw", "napisz", "kliknij", "введите", "напишите", "вставьте", "ここに", "在此", "在这里", "skriv ", "buraya", "여기에")
CODE_KEYS = ("your code", "your solution", "your answer", "replace none", "insert your", "fill in", "___", "begin ")
FILLER_KEYS = ("filler", "placeholder", "dummy", "sample", "platzhaltertext", "blindtext", "relleno", "remplissage", "faux", "texto", "segnaposto", "riempimento", "vultekst", "zastępczy", "рыба", "заполнитель", "ダミー", "占位", "lorem", "dolor sit", "consectetur")
WORD = re.compile(r"[^\W\d_]+")
ONLY_WORDS = re.compile(r"^[^\W\d_]+(?:[ ,;.!?]+[^\W\d_]+)*[ ,;.!?]*$")
MASHED = re.compile(r"^[asdfghjkl; ,.]+$|^[qwertyuiop ,.]+$|^[zxcvbnm ,.]+$", re.I)
VOWEL = re.compile(r"[aeiouyäöüéèêàáíóúãõâôîåæøœı]", re.I)

_THING = r"(?:java\s?script|\bjs\b|\bscripts?\b|scripting|skripte?n?\b|\bскрипт\w*|脚本|スクリプト|스크립트|cookies?\b|куки|クッキー|쿠키|active\ content)"
_MATTER = (
    r"(?:enabl|turn(?:ed)?\ on|switch(?:ed)?\ on|\bis\ on\b|allow|activ[aeé]|aktiv|abilit|attiv|inschakel|ingeschakeld|schakel|włącz|включ|разреш|etkinleştir|aktivera|habilit|\bative|permit|requir|\bneed|necesit|precis|besoin|nécess|benötig|erforder|richie[ds]|vereist|nodig|wymag|требу|krävs|gerek|disabled|turned\ off|blocked"
    r"|deaktivier|désactiv|desactiv|desativ|disattiv|uitgeschakeld|wyłącz|отключ|devre\ dışı|support|unterstütz|soport|suport|en\ charge|obsłu|поддерж|ondersteun|without|\bohne|\bsans|\bsin\b|\bsem\b|senza|zonder|\bbez\b|\bбез\b|utan|有効|必要|無効|启用|啟用|需要|禁用|开启|활성화|필요|blockiert|bloqu|blocc|geblokkeerd|zablokow)"
)
_PLACE = r"(?:pages?|sites?|website|url|address|files?|notebooks?|documents?|resources?|services?|servers?|gateways?|kernel|repositor\w+|projects?|links?|requests?|host|connection|viewer|code\ block|content|preview|seite|dienst|datei|server\w*|página|sitio|servicio|archivo|servidor|serviço|arquivo|pagina|sito|servizio|risorsa|bestand|strona|stron[ąęy]|usługa|serwer|plik|страниц\w*|сервис|сервер|файл|sidan?|tjänsten|sayfa|sunucu|fichier|serveur|carnet|cuaderno|caderno|ページ|サーバー|サービス|ファイル|页面|服务器?|文件|网页|網頁|페이지|서버|서비스)"
_GONE = (
    r"(?:not\ (?:be\ )?found|unavailable|n['’]t\ (?:here|exist|available|be)|not\ (?:exist|available|reachable|be|responding)|no\ longer|has\ (?:moved|been)|moved|deleted|removed|\bprivate|\bdown\b|maintenance|overload|time[d-]?\ ?out|too\ large|broken|gave\ up|went\ wrong|refused|nicht\ (?:gefunden|verfügbar|erreichbar|angezeigt|dargestellt)|gelöscht|wartung|überlast|introuvable|indisponible|n['’]existe|pas\ (?:disponible|trouvé)"
    r"|no\ (?:(?:está|es|esta)\ )?(?:existe|encontrad|disponible|accesible|se\ (?:encontr|ha\ encontr|puede|pudo))|mantenimiento|não\ (?:encontrad|existe|foi|está|pôde)|indisponível|manutenção|non\ (?:è\ )?(?:stata\ )?(?:trovat|disponibil|esist|raggiungi)|manutenzione|niet\ (?:gevonden|beschikbaar|bereikbaar|bestaat)|onderhoud|nie\ (?:znalezion|istnieje|odnalezion|została)|niedostępn|konserwacj|не\ (?:найден|существует|доступ|отвечает)|недоступ|обслуживани|hittades\ inte|inte\ (?:tillgänglig|hittas)|bulunamadı|kullanılamıyor"
    r"|見つかりません|存在しません|利用できません|表示できません|メンテナンス|不存在|未找到|找不到|无法|不可用|维护|찾을\ 수\ 없|없습니다|점검)"
)
_RIGHT = r"(?:access|permissions?|authori[sz]\w+|zugriff|zugang|berechtigung\w*|accès|autorisation|acceso|permisos?|acesso|permissão|accesso|permess[oi]|autorizza\w+|toegang|rechten|dostęp\w*|uprawnie\w+|доступ\w*|прав\b|åtkomst|behörighet|erişim|アクセス|権限|访问|权限|접근|권한)"
_DENIED = r"(?:denied|forbidden|restricted|refused|(?:do\ not|don['’]t|not)\ have|no\ permission|need|request|refus|verweigert|keine|nicht|denegad|no\ tiene|negad|não\ tem|negat|non\ (?:hai|dispon|autorizz)|geweigerd|geen|niet|odmow|zabron|brak|nie\ masz|запрещ|закрыт|отказ|нет|nekad|saknar|engellendi|reddedildi|拒否|禁止|ありません|拒绝|被拒|没有|無|거부|없습니다)"
_LOGIN = r"(?:log(?:ged)?[ -]?(?:in|on)\b|sign(?:ed)?[ -]?in|session\b|account|anmeld\w*|melden\ sie\ sich|einlogg\w*|sitzung|connect(?:er|é|ez)|identifi\w+|sesión|identifíquese|entr[ea]\ (?:na|com)|faça\ login|sessão|acced[ie]\w*|effettua\w*|sessione|inlog\w*|aanmeld\w*|sessie|zalog\w*|sesj\w*|войти|войдите|авториз\w*|сесси\w*|сеанс|logga\ in|oturum|giriş\ yap\w*|ログイン|セッション|サインイン|登录|登入|会话|로그인|세션)"
_ASKED = r"(?:must|need|please|require|to\ (?:continue|view|access|see|proceed|read|open)|again|expired?|timed\ out|ended|bitte|müssen|erforderlich|abgelaufen|veuillez|devez|doit|expir|caduc|debe|inicie|por\ favor|deve|necessário|scadut|per\ (?:continuare|visualizzare|favore)|devi|verlopen|moet|om\ (?:verder|door)|wygas|aby|musisz|proszę|истек|чтобы|необходимо|пожалуйста|gått\ ut|måste|för\ att|süresi|lütfen|gerek|必要|期限|してください|切れ|请|請|先|过期|필요|만료|해\ 주세요)"
#: Reason phrases of the HTTP status codes that pages show, and their names in other languages. Fixed values.
_REASON = r"(?:bad\ request|unauthori[sz]ed|forbidden|not\ found|method\ not\ allowed|request\ time-?out|conflict|gone|too\ many\ requests|internal\ server\ error|not\ implemented|bad\ gateway|service\ (?:temporarily\ )?unavailable|gateway\ time-?out)"
_ERROR = r"(?:errors?|fehler|erreur|erro|errore|fout\w*|błąd|ошибка|fel|hata|エラー|错误|오류|code|status|http)"

NOTICES = re.compile(
    rf"""(?xi)
    {_THING}[^\n]{{0,80}}?{_MATTER} | {_MATTER}[^\n]{{0,60}}?{_THING} | <noscript>
    | {_RIGHT}[^\n]{{0,40}}?{_DENIED} | {_DENIED}[^\n]{{0,40}}?{_RIGHT}
    | {_LOGIN}[^\n]{{0,60}}?{_ASKED} | {_ASKED}[^\n]{{0,40}}?{_LOGIN}
    | {_PLACE}[^\n]{{0,60}}?{_GONE} | {_GONE}[^\n]{{0,40}}?{_PLACE} | \bunable\ to\ (?:render|load|display|connect|open|fetch)\b
    | \b[45]\d\d\b[\s\W]{{0,6}}{_REASON} | ^{_REASON}\.?$ | {_ERROR}[\s:#(]{{0,3}}[45]\d\d\b | ^[45]\d\d\.?$ | \b[45]\d\d[\s:-]{{1,3}}{_ERROR} | "(?:status|code|error)":\s*"?[45]\d\d | "(?:error|message)":\s*"
    | \btoo\ many\ requests\b | \brate\ limit\w*\b[^\n]{{0,30}}\b(?:exceeded|reached|hit)\b | \bquota\ (?:exceeded|reached)\b | \bnot\ a\ robot\b | \bare\ you\ (?:a\ )?human\b | \bverify(?:ing)?\ (?:that\ )?you\b | \bcaptcha\b | \bchecking\ your\ browser\b | \bunusual\ traffic\b | \bray\ id\b
    | \bzu\ viele\ anfragen\b | \btrop\ de\ requêtes\b | \bdemasiadas\ (?:solicitudes|peticiones)\b | \bmuitas\ (?:solicitações|requisições)\b | \btroppe\ richieste\b | \bte\ veel\ (?:verzoeken|aanvragen)\b | \bzbyt\ wiele\ (?:żądań|zapytań)\b | слишком\ много\ запросов | リクエストが多すぎ | ロボットでは | 请求过(?:多|于频繁) | 机器人 | 요청이\ 너무
    | \bsomething\ went\ wrong\b | \bverbindung\b[^\n]{{0,20}}\bfehlgeschlagen\b
    """
)
#: Words of texts that tell of data, code or lessons, in which scripts and errors are a subject.
NARRATIVE = re.compile(
    r"(?i)\b(?:plot\w*|chart\w*|histogram\w*|figures?|tables?|rows?|columns?|datasets?|data ?frames?|analy[sz]\w+|measur\w+|compar\w+|averag\w+|counts?|counted|per (?:day|hour|week|month)|tutorials?|chapters?|lessons?|exercises?|examples?|explain\w*|describe[sd]?|learn\w*|handlers?|middleware|clients?|crawlers?|scrap\w+|pars(?:e[sd]?|er|ing)|tests?|retr(?:y|ies) (?:logic|policy|with|after)|functions?|returns?|returned|raise[sd]?|log files?|logs|logged|students?|articles?|history|meeting|users|developers?|how to|this section|we (?:use|show|see|plot|log|count|collect|measure|store|treat|drop|retry|found that)"
    r"|diagramm\w*|tabelle\w*|kapitel|beispiel\w*|übung\w*|lektion|tableau|chapitre|exemple|exercice|gráfic\w+|tabla|capítulo|ejemplo|ejercicio|exemplo|exercício|grafic\w+|tabella|capitolo|esempio|grafiek|hoofdstuk|voorbeeld|wykres\w*|rozdział\w*|przykład\w*|график\w*|таблиц\w*|глав[аеу]|пример\w*)\b|グラフ|章では|例を|图表|本章|示例"
)
TRACE = re.compile(r"^\s*(?:File \".*\", line \d+|at [\w.$<>]+ ?\(|Traceback \(|Caused by:|\.\.\. \d+ more|[\w.]+(?:Error|Exception)\b:?|#\d+ )|^\s{2,}\w+.*[()=]|^\s*(?:apache|nginx|openresty|iis|lighttpd|cloudflare|varnish|tomcat)\b[/\w. ()-]*", re.I)
MENU = re.compile(r"^[^|>·•/\n]{1,24}(?:\s[|>·•/]\s[^|>·•/\n]{1,24}){1,}$")
HTML = re.compile(r"<[^<>]{1,80}>")
CJK = re.compile(r"[぀-ヿ㐀-鿿가-힯]")

_CELL = re.compile(r'<cell kind="(md|code)"[^>]*>\n?(.*?)(?:</cell>|\Z)|<output>\n?(.*?)(?:</output>|\Z)', re.S)
_JSON = json.JSONDecoder(strict=False)


def _tidy(text: str) -> str:
    for a, b in (("\r\n", "\n"), ("\r", "\n"), ("﻿", ""), ("\xa0", " "), (" ", " "), ("​", ""), ("â€™", "'"), ("â€œ", '"'), ("â€\x9d", '"'), ("Â«", "«"), ("Â»", "»")):
        if a in text:
            text = text.replace(a, b)
    return text


def _of_notebook(text: str) -> list[tuple[str, str]] | None:
    at = text.find("{")
    try:
        book, _ = _JSON.raw_decode(text, at)
        cells = []
        for cell in book["cells"]:
            source = cell.get("source") or ""
            cells.append(("md" if cell.get("cell_type") in ("markdown", "raw", "heading") else "code", source if isinstance(source, str) else "".join(map(str, source))))
        return cells
    except (ValueError, KeyError, TypeError, AttributeError):
        return None


def cells_of(text: str) -> list[tuple[str, str]]:
    """(kind, text) with kind md or code; outputs are left out. Forms that are not known read as text."""
    text = _tidy(text)
    head = text.lstrip()
    if head.startswith("{") and '"cells"' in text:
        found = _of_notebook(head)
        if found is not None:
            return found
        text = text.replace('\\n",', "\n").replace("\\n", "\n").replace('\\"', '"')
    if '<cell kind="' in text:
        return [("md" if m[1] == "md" else "code", m[2]) for m in _CELL.finditer(text) if m[1]]
    if "# %%" in text:
        cells = []
        for part in re.split(r"(?m)^# %%", text):
            first, _, rest = part.partition("\n")
            if "[markdown]" in first:
                cells.append(("md", "\n".join(x[2:] if x.startswith("# ") else x.lstrip("#") if x.strip() == "#" else x for x in rest.split("\n"))))
            elif part.strip():
                cells.append(("code", "\n".join(x for x in rest.split("\n") if not x.startswith("#>"))) if first.strip() or rest else ("md", part))
        return cells
    if "```" in text:
        cells = []
        for i, part in enumerate(re.split(r"(?m)^```", text)):
            if i % 2 == 0:
                cells.append(("md", part))
            else:
                language, _, body = part.partition("\n")
                if language.strip().lower() not in ("text", "output"):
                    cells.append(("code", body))
        return cells
    if re.search(r"(?m)^(?:In|Out) ?\[[ \d]*\]:", text):
        cells = []
        for part in re.split(r"(?m)^(?=(?:In|Out) ?\[[ \d]*\]:)", text):
            first, _, rest = part.partition("\n")
            if not re.match(r"(?:In|Out) ?\[", first):
                cells.append(("md", part))
                continue
            blocks = re.split(r"\n\s*\n", rest)
            take = 1
            while take < len(blocks) and _is_code(blocks[take]):
                take += 1
            if first.startswith("In"):
                cells.append(("code", "\n\n".join(blocks[:take])))
            cells.append(("md", "\n\n".join(blocks[take:])))
        return cells
    return [("md", text)]


def _is_code(block: str) -> bool:
    """Whether a paragraph behind a code cell's first one goes on with code."""
    line = block.strip().split("\n")[0]
    return bool(re.match(r"(?:[ \t]|def |class |import |from |for |if |with |return |print\(|###|@|\}|\w[\w.\[\]']* ?(?:=|<-) ?\S|\w+\(.*\)$)", block if block[:1] in " \t" else line))


def _is_field(slot: str) -> bool:
    """Whether a likely slot is named like a field of a form, and not by one of Python's own names."""
    name = slot.strip("{}[]<>%«» ")
    if name.startswith("__") and name.strip("_").lower() in DUNDER:
        return False
    name = name.strip("_")
    return name.isupper() or bool(FIELD.search(name))


def has_slot(lines: list[str]) -> bool:
    """lines of running text; a paragraph is a run of lines that are not blank."""
    start = 0
    for end in range(len(lines) + 1):
        if end < len(lines) and lines[end].strip():
            continue
        block = lines[start:end]
        start = end + 1
        if not block or not any(SLOT_SIGNS.search(x) for x in block):
            continue
        for line in block:
            bare = line.strip()
            if SLOT_SIGNS.search(bare) and (TITLE.match(bare) or KEYED.match(bare)):
                found = ANY.findall(bare)
                if CERTAIN.search(bare) or any(_is_field(x) or PLAIN_NAME.fullmatch(x) for x in found):
                    return True
        text = TAG.sub(" ", QUOTED.sub(" ", "\n".join(block)))
        slots = CERTAIN.findall(text)
        certain = len(slots) and (len(slots) > 1 or len(slots[0]) >= CERTAIN_SHARE * len(text.strip()))
        if not certain:
            likely = [x for x in LIKELY.findall(text) if _is_field(x)]
            certain = (len(likely) + len(slots) > 1 and slots) or sum(map(len, likely)) >= LIKELY_SHARE * len(text.strip()) > 0
        if certain and not ABOUT.search(ANY.sub(" ", "\n".join(block))):
            return True
    return False


def _lines_with(text: str, keys: tuple[str, ...]) -> set[str]:
    """The lines of a lower-case text that hold one of the keys."""
    found = set()
    for key in keys:
        at = text.find(key)
        while at >= 0:
            start, end = text.rfind("\n", 0, at) + 1, text.find("\n", at)
            end = len(text) if end < 0 else end
            found.add(text[start:end])
            at = text.find(key, end)
    return found


def has_prompt(low: str) -> bool:
    """low: running text in lower case."""
    return any((PROMPTS.search(x) or MORE_PROMPTS.search(x)) and any(p.search(QUOTED.sub(" ", x)) for p in (PROMPTS, MORE_PROMPTS)) for x in _lines_with(low, PROMPT_KEYS))


def is_filler(lines: list[str]) -> bool:
    for bare in _lines_with("\n".join(lines).lower(), FILLER_KEYS):
        if FILLER.search(bare) and FILLER.search(QUOTED.sub(" ", bare)) and not ABOUT.search(FILLER.sub(" ", bare)):
            return True
    stubs = 0
    pseudo: list[str] = []
    for line in lines:
        bare = line.strip()
        if len(bare) < 8:
            continue
        if ":" in bare and STUB.match(bare):
            stubs += 1
            if stubs >= STUB_LINES:
                return True
            continue
        bare = bare.strip("*_->•# ")
        if bare.count(" ") < 3:
            continue
        words = WORD.findall(bare.lower())
        if len(words) >= REPEATED_WORDS:
            if len(set(words)) <= 3:
                return True
            if sum(len(w) > 1 for w in words) >= REPEATED_WORDS and MASHED.match(bare) and len({*words}) > 3:
                return True
        # a word of up to three letters, or many capitals, as in lists of names, belong to real text
        if ONLY_WORDS.match(bare) and min(map(len, words)) > 3 and sum(w[:1].isupper() for w in WORD.findall(bare)) * 2 < len(words):
            pseudo.extend(words)
            if "lorem" in words:
                return True
    return len(pseudo) >= PSEUDO_WORDS and len(pseudo) - len(set(pseudo)) >= max(2, len(pseudo) // 8)


def is_notice(cells: list[tuple[str, str]]) -> bool:
    if any(kind == "code" and text.strip() for kind, text in cells):
        return False
    lines = [x.strip(" \t*_\"'") for _, text in cells for x in text.split("\n") if not TRACE.match(x)]
    lines = [x for x in lines if x]
    if not lines or sum(map(len, lines)) > 8 * NOTICE_CHARS:
        return False
    found, others = [], []
    for i, line in enumerate(lines):
        bare = line.lstrip("#> ")
        if NOTICES.search(bare):
            found.append(HTML.sub(" ", bare) if not bare.startswith("<noscript") else bare)
        elif not MENU.match(line) and len(WORD.findall(HTML.sub(" ", line))) > (6 if i == 0 or line.startswith("#") else 4):
            others.append(HTML.sub(" ", line))
        elif CJK.search(line) and len(line) > 12 and i:
            others.append(line)
    if not found:
        return False
    text = " ".join(found + others)
    if len(text) > NOTICE_CHARS or len(WORD.findall(text)) > NOTICE_WORDS:
        return False
    # what stands beside the notice is no longer than the notice itself, and nothing tells of data or lessons
    return sum(map(len, others)) <= max(160, sum(map(len, found))) and not NARRATIVE.search(" ".join(x for x in found + others if not x.startswith("{")))


def is_residue(text: str) -> bool:
    """Whether a text is a case; null, empty and blank texts are none."""
    if not text or text.isspace():
        return False
    cells = cells_of(text)
    lines: list[str] = []
    for kind, body in cells:
        if kind == "md":
            lines.extend(body.split("\n"))
            lines.append("")
        elif any(x in body.lower() for x in CODE_KEYS) and CODE_PROMPTS.search(body):
            return True
    return has_slot(lines) or has_prompt("\n".join(lines).lower()) or is_filler(lines) or is_notice(cells)


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = pa.array([is_residue(x) for x in batch.column(1).to_pylist()], pa.bool_())
        yield pa.record_batch([batch.column(0).filter(keep)], names=["doc_id"])


def residue(documents: DataFrame) -> DataFrame:
    """(doc_id) of the documents to leave out. Null, empty and blank texts are no cases; a repeated row comes once for each
    time it stands in the table; other columns are ignored, whatever their names."""
    return spread(documents.where(F.col("text").isNotNull()).select("doc_id", "text")).mapInArrow(_judged, "doc_id long")
