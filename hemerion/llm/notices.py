"""Residue that editors have confirmed: the trusted labels that spread over the corpus.

Sentences as error pages, script notices, content systems and page templates put them, in four
languages. They need not be complete: a corpus sentence is labelled if it is near one of
them or near a labelled sentence. Pass an own list where other systems are in use.
"""

from __future__ import annotations

#: Wordings of notices, error pages and filler.
NOTICES = [
    # scripts and cookies are required
    "Please enable JavaScript to continue.", "Please enable JavaScript to continue reading this briefing.", "You need to enable JavaScript to run this app.",
    "You need to enable scripts and cookies to run this app.", "JavaScript is disabled in your browser.", "This site requires JavaScript to work properly.",
    "Please enable cookies and reload the page.", "Your browser does not support JavaScript.", "Your browser is out of date.",
    "Este sitio necesita JavaScript para funcionar.", "Actívelo y recargue la página.", "Active JavaScript en su navegador para continuar.",
    "Para ver la transcripción debe habilitar JavaScript en su navegador.", "Contenido dinámico no disponible: los scripts están desactivados.",
    "Su navegador no admite scripts; el reproductor no puede mostrarse.", "Es necesario habilitar las cookies para ver este sitio.",
    "Ative o JavaScript do seu navegador para visualizar a página.", "Este site precisa de JavaScript para funcionar.",
    "Veuillez activer JavaScript pour afficher cette conférence.", "Vous devez activer JavaScript pour voir cette page.",
    # checks and blocks
    "Comprobando su navegador antes de entrar al sitio.", "Este proceso es automático.", "Checking your browser before accessing the site.",
    "This process is automatic.", "Verifying you are human.", "Verificando que usted es humano.", "Demasiadas solicitudes.", "Too many requests.",
    "Espere 30 segundos y vuelva a intentarlo.", "Su solicitud fue bloqueada por la política de seguridad.", "Your request has been blocked.",
    "Su sesión ha expirado.", "Your session has expired.", "Vuelva a iniciar sesión para ver este contenido.", "Please log in again to view this content.",
    "Inicie sesión para continuar.", "Sua sessão expirou.", "Votre session a expiré.",
    # error pages
    "404 Not Found", "403 Forbidden", "500 Internal Server Error", "502 Bad Gateway", "503 Service Unavailable", "504 Gateway Timeout",
    "HTTP 404 Not Found: the requested document was not located on this server.", "The requested URL was not found on this server.",
    "The server encountered an internal error and was unable to complete your request.", "The service is temporarily unavailable.",
    "This page isn't working.", "This page is having trouble loading.", "Oops! Something went wrong on our side.", "Something went wrong.",
    "Try again later.", "Please try again later.", "We can't seem to find the page you're looking for.", "We can't seem to find the briefing you're looking for.",
    "Go back home.", "Page not found.", "Access denied.", "You don't have permission to access this resource.",
    "Error 404", "Error 404. La página que busca no existe.", "La página que busca no existe o cambió de lugar.", "404 Página no encontrada",
    "Volver al inicio", "Acceso denegado.", "Error interno del servidor.", "503 Servicio no disponible", "Servicio no disponible.",
    "El sitio está en mantenimiento programado.", "Estamos en mantenimiento.", "Recargue la página en unos minutos.",
    "No se pudo establecer la conexión con la base de datos.", "Error al establecer una conexión con la base de datos.",
    "Error establishing a database connection", "Se agotó el tiempo de espera de la pasarela.", "Contenido retirado o no disponible en su región.",
    "Error al cargar el documento: respuesta vacía del origen.", "Inténtelo más tarde o avise al administrador.", "Inténtelo de nuevo más tarde.",
    "Lo sentimos, algo salió mal.", "Ocurrió un error inesperado.", "Se ha producido un error.", "El archivo solicitado no existe.",
    "Página não encontrada", "Verifique o endereço e tente novamente.", "Tente mais tarde.", "Erro interno do servidor.", "Algo deu errado.",
    "Acesso negado.", "Page introuvable", "Erreur interne du serveur.", "Une erreur est survenue.", "Veuillez réessayer plus tard.", "Accès refusé.",
    # filler and text of templates
    "Lorem ipsum dolor sit amet.", "Consectetur adipiscing elit sed do eiusmod tempor.", "Texto de relleno.", "Texto de prueba.", "Texto de ejemplo.",
    "Nota por definir.", "Contenido por definir.", "Contenido de prueba, no publicar.", "Sustituir antes de publicar.", "Sustituya este texto antes de publicar.",
    "Pendiente de redactar", "Bajada pendiente / balazo pendiente / cuerpo pendiente", "Título de ejemplo", "Párrafo de ejemplo", "Pie de foto de ejemplo",
    "Ejemplo de encabezado. Ejemplo de subtítulo. Ejemplo de cuerpo.", "Ejemplo de encabezado", "Ejemplo de subtítulo", "Ejemplo de cuerpo",
    "Aquí va el cuerpo de la nota.", "Aquí va el título.", "Escriba aquí la pregunta del reportero y debajo la respuesta.", "Escriba aquí su texto.",
    "Completar con la versión final", "Your text goes here.", "Your title goes here.", "Insert your text here.", "This is placeholder text.",
    "Add your content here.", "This is a sample page.", "Hello world! This is your first post.", "Edit or delete it, then start writing!", "Click to edit this text.",
    "Insira o texto aqui.", "Texto de exemplo.", "Substitua este texto.", "Texte à venir.", "Texte de remplissage.", "Remplacez ce texte.",
]

#: Signs of a program's own output or of typed filler, folded, each with the words it is known by.
MACHINE = {
    r"\blorem ipsum\b": "lorem ipsum", r"\bdolor sit amet\b": "dolor sit amet", r"\b(?:asdf|qwerty) (?:asdf|qwerty)\b": "asdf asdf",
    r"(?:\bx{4,}\b ?){2,}": "xxxxx xxxxx", r"\btk tk tk\b": "tk tk tk", r"\btraceback \(most recent call last\)": "traceback most recent call last",
    r"\bfatal error: uncaught\b": "fatal error uncaught", r"<noscript>": "noscript noscript", r"<title> ?[345]\d\d ?</title>": "title 0 title",
    r"^(?:texto|contenido|cuerpo) de relleno\b": "texto de relleno", r"\{ ?\"?(?:status|error|code)\"? ?: ?\"?[345]\d\d": "status 0 error",
}

#: The syntax of fields that a template engine or a writer should have filled, of any length.
PLACEHOLDERS = [
    r"\{\{[^{}]*\}\}", r"\{%[^{}]*%\}", r"\$\{[^{}]*\}", r"%\([^()\s]+\)[sd]", r"@@[^@\s]+@@", r"<<[^<>\n]+>>", r"<%[^<>%]*%>",
    r"(?<![\w#])#[A-ZÁÉÍÓÚÑ][A-ZÁÉÍÓÚÑ_]+#", r"(?<!\w)__[A-ZÁÉÍÓÚÑ][A-ZÁÉÍÓÚÑ_]+__(?!\w)", r"(?<![\{\w$\"'])\{[a-záéíóúñ_]{2,}\}(?!\})",
    r"\[\s*(?i:insertar|inserte|insert|inserir|insira|insérer)\b[^\[\]\n]*\]", r"\[[^\[\]\n]+(?i:aquí|aqui|here|ici)\s*\]",
    r"\[\s*(?i:nombre|fecha|cargo|lugar|monto|título|titulo|medio|folio|municipio)\s+(?:del?|de la)\s[^\[\]\n]+\]",
    r"\bXX+\s+de\s+XX+(?:\s+de\s+(?:20)?XX+)?",
]
