"""Held-out wordings of residue, and content that only resembles it; no exemplar was written from them."""

PARAPHRASES = [
    "The page you tried to open could not be found on this server.",
    "Sorry, this page does not exist any more.",
    "We are sorry, but the page you are looking for has been removed.",
    "This article is no longer available.",
    "Your search did not match any results.",
    "Service is temporarily unavailable, please try again in a few minutes.",
    "An unexpected error occurred. Please try again later.",
    "The site is down for scheduled maintenance and will be back shortly.",
    "You do not have permission to access this page.",
    "Please log in to view this content.",
    "JavaScript must be enabled in your browser to view this site.",
    "Please turn on JavaScript in your browser to use this app.",
    "We are checking your browser before you can access the site. Please wait.",
    "Please verify that you are human to continue.",
    "Fatal error: call to undefined function render_page() in template.php on line 41",
    "Sed do eiusmod tempor incididunt ut labore et dolore magna aliqua, quis nostrud exercitation.",
    "This is placeholder text, please replace it with your content.",
    "Die aufgerufene Seite wurde leider nicht gefunden.",
    "Diese Seite ist nicht mehr verfügbar oder wurde gelöscht.",
    "Ihre Suche ergab leider keine Treffer.",
    "Es ist ein Fehler aufgetreten. Bitte versuchen Sie es später erneut.",
    "Diese Website ist wegen Wartungsarbeiten vorübergehend nicht erreichbar.",
    "Sie haben keine Berechtigung, diese Seite anzusehen.",
    "Bitte aktivieren Sie JavaScript, um diese Website nutzen zu können.",
    "Bitte bestätigen Sie, dass Sie ein Mensch und kein Roboter sind.",
    "Bitte ersetzen Sie diesen Blindtext durch Ihren eigenen Text.",
    "La page que vous avez demandée est introuvable.",
    "Désolé, cette page n'existe plus ou a été supprimée.",
    "Aucun résultat n'a été trouvé pour votre recherche.",
    "Une erreur est survenue. Merci de réessayer plus tard.",
    "Le site est en maintenance, veuillez revenir plus tard.",
    "Vous n'avez pas l'autorisation d'accéder à cette page.",
    "Veuillez activer JavaScript dans votre navigateur pour afficher ce site.",
    "Vérification de votre navigateur en cours. Veuillez patienter.",
    "Remplacez ce texte d'exemple par votre contenu.",
    "La página que está buscando no se encuentra o no existe.",
    "Lo sentimos, este contenido ya no está disponible.",
    "No se han encontrado resultados para su búsqueda.",
    "Se ha producido un error. Inténtelo de nuevo más tarde.",
    "El sitio está en mantenimiento, vuelva a intentarlo más tarde.",
    "No tiene permiso para ver esta página.",
    "Active JavaScript en su navegador para ver este sitio.",
    "Estamos comprobando su navegador. Espere unos segundos.",
    "Sustituya este texto de ejemplo por su propio texto.",
]

CONTENT = [
    "The library was closed for maintenance of the roof last spring, and readers walked to the next town.",
    "Our reporter tried the new site of the council and wrote down every error it showed, from lost pages to broken forms.",
    "In the museum a sign says that the page of the old atlas could not be found for ninety years.",
    "JavaScript was written in ten days, and browsers have run it ever since.",
    "Der Server im Keller der Schule war alt, doch die Kinder lernten darauf das Programmieren.",
    "La page du vieux livre est introuvable depuis la guerre, raconte la bibliothécaire du village.",
    "El sitio de la feria se trasladó al otro lado del río, y los vecinos lo agradecieron.",
    "Cicero wrote about pain and pleasure; typesetters later cut his sentences into filler.",
]
