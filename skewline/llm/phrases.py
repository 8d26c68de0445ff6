"""Phrases that label text weakly as residue.

They are compared without white space, accents and letter case (see ``segments.squeeze``), so scanning errors of those
kinds don't matter.
"""

from __future__ import annotations

#: notices that scripts or cookies are required
SCRIPTS = (
    "please enable javascript", "enable javascript", "javascript is required", "requires javascript", "turn on scripts", "turn on javascript", "scripting disabled", "javascript is disabled", "active scripting", "allow scripts",
    "blocks scripts", "scripts are required", "enable it and reload", "enable scripts", "document viewer could not start", "<noscript>", "javascript and cookies", "enable cookies",
    "aktivieren sie javascript", "javascript aktivieren", "benötigt javascript", "erfordert javascript", "aktivierte skripte", "javascript und cookies",
    "nécessite javascript", "activez javascript", "activez les scripts", "activer javascript", "javascript est nécessaire", "scripts désactivés", "javascript et les cookies", "javascript et des cookies",
    "necesita scripts", "necesita javascript", "requiere javascript", "active javascript", "habilite javascript", "activar javascript", "active los scripts", "javascript y cookies",
    "スクリプトを許可", "スクリプトを有効", "javascriptを有効", "javascriptを許可", "javascriptが必要", "需要脚本", "启用浏览器的javascript", "启用javascript", "启用脚本", "需要javascript", "开启javascript",
)
#: error pages and messages
ERRORS = (
    "requested url", "was not found on this server", "internal server error", "bad gateway", "gateway timeout", "upstream host", "service temporarily unavailable", "service unavailable", "temporarily unavailable", "http status", "http error",
    "too many requests", "session has timed out", "session has expired", "your session", "please log in again", "log in again", "access denied", "access to this", "do not have permission", "something went wrong",
    "cannot be displayed", "page can't be found", "page cannot be found", "page not found", "document has moved", "not redirected within", "could not load", "query failed", "lock wait exceeded", "try again in", "try again later",
    "exception:", "exception in thread", "traceback (most recent", "no text for key", "syntax error", "fatal error", "undefined index", "connection refused", "connection timed out", "loading... if nothing happens", "oops!", "403 forbidden", "401 unauthorized",
    "interner serverfehler", "vorübergehend nicht verfügbar", "versuchen sie es in", "versuchen sie es später", "zugriff verweigert", "sitzung ist abgelaufen", "melden sie sich erneut", "wurde nicht gefunden", "seite nicht gefunden", "existiert nicht mehr",
    "page demandée est introuvable", "page est introuvable", "introuvable", "momentanément indisponible", "réessayez dans", "session a expiré", "veuillez vous reconnecter", "reconnectez-vous", "accès refusé", "erreur interne", "erreur serveur",
    "no se ha encontrado la página", "página no encontrada", "servicio no disponible", "inténtelo", "sesión ha caducado", "sesión ha expirado", "vuelva a iniciar sesión", "acceso denegado", "error interno", "error del servidor",
    "サーバ内部エラー", "エラーが発生しました", "受付番号", "アクセスが集中", "再度お試し", "セッションの有効期限", "再度ログイン", "見つかりませんでした", "ページは見つかりません", "アクセスが拒否", "アクセス権", "ご利用いただけません", "お探しのページ", "表示できません", "混み合って", "読み込めません", "接続できません",
    "您访问的页面", "页面不存在", "服务器内部错误", "内部服务器错误", "请求编号", "访问被拒绝", "拒绝访问", "会话已过期", "会话已超时", "重新登录", "服务暂时不可用", "暂时不可用", "稍后再试", "后再试", "系统繁忙", "网络错误", "加载失败", "出错了", "请求过于频繁", "无权访问", "无法显示", "抱歉",
)
#: filler text
FILLER = (
    "lorem ipsum", "sample text", "dummy text", "placeholder text", "test entry", "do not publish", "content goes here", "text goes here", "blah blah", "text text text", "your own content", "replace it with your", "replace this text", "diesen text ersetzen", "ersetzen sie diesen", "texte à remplacer", "exemple de texte", "texto a sustituir", "reemplace este texto", "sustituya este texto", "foo bar", "[dummy]", "dummy paragraph", "dummy content", "test content", "for layout purposes", "beispielinhalt", "testinhalt", "testtext", "contenu d'exemple", "contenu de test", "texte de test", "contenido de ejemplo", "contenido de prueba", "テスト文章", "テストテキスト", "サンプルです", "仮のテキスト", "测试内容", "示例内容", "样例文本", "asdf asdf", "asdfasdf", "qwertz", "qwerty",
    "blindtext", "platzhaltertext", "mustertext", "beispieltext", "texte factice", "faux texte", "texte de remplissage", "texto de relleno", "texto de ejemplo", "texto de prueba", "texto ficticio",
    "ダミーテキスト", "ここに文章が入ります", "サンプルテキスト", "テキストが入ります", "占位文字", "占位文本", "示例文字", "示例文本", "测试文本",
)
#: notes to fill something in
NOTES = (
    "goes here]", "goes here>", "goes here)", "[insert", "<insert", "(insert", "(enter", "[enter", "<enter", "to be completed]", "to be inserted", "to be added]", "to be added)", "to be added>", "to be filled", "to be supplied", "must be switched on", "[... paragraphs", "[...]",
    "noch zu ergänzen", "hier einfügen", "bitte ersetzen", "bitte ausfüllen", "bitte eintragen", "eintragen)", "eintragen]", "folgt>", "folgt]", "folgt)", "to follow]", "to follow>", "à venir]", "à insérer", "por insertar", "pendiente]", "pendiente)", "einfügen]", "einfügen>", "einfügen)", "bitte ergänzen", "nachtragen", "à compléter", "à remplir", "insérer ici", "[insérer", "<insérer", "[insertar", "<insertar", "(insertar", "rellenar aquí", "por completar", "por rellenar", "completar aquí",
    "此处填写", "此处输入", "请输入", "请填写", "待补充", "待填写", "を入力してください", "ここに入力", "ここに記入", "を記入", "（入力", "（記入",
)
#: fixed values: the words of the usual filler Latin
FILLER_WORDS = tuple(
    "lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat "
    "duis aute irure in reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
)
