"""The small labelled table that the tagger of personal data is trained on.

Written by hand as carrier sentences with slots and short lists of invented or common values; `labelled()` fills the
slots with a fixed seed. `{x}` is a slot of a labelled type, `<x>` one of filler without a label.
"""

from __future__ import annotations

import random
import re
import string

TYPES = ("email", "phone", "id_number", "street_address", "person_name")

GIVEN = """Alice Robert Maria Thomas Julia Peter Laura Daniel Sarah Michael Anna Paul Eva Martin Nina David Helen George Emma Oliver Sofia Lucas Chloé Antoine Élodie Pierre Céline
Mathieu Inès Jürgen Käthe Björn Sören Günther Anke Heike Uwe Carmen Javier Lucía José Ángel Pilar Nuria Iván Íñigo Begoña Ravi Anita Wei Mei Kenji Yuki Omar Leila Amina Tariq Chidi Ngozi Kwame
Olga Dmitri Ivana Milos Zofia Pawel Jana Tomáš Agnes Sven Astrid Lars Freya Nils Marta Marco Dario Mateo Inés Rosa Camille Mireille Samir Selma Emil Henrik Oskar Clara Hugo Leonie Felix Greta
Judith Noor Elin Ruben Jonas Yusuf Tomás Nadia Ivo Zora Odile Priya Solène Arjun Bastian Kofi Ingrid Amara Anselm Tilda Piet Anne-Lise Jean-Marc Marie-Claire Karl-Heinz José-Luis Anna-Lena""".split()
STEMS = "Alder Berg Brand Calder Dorn Eck Fair Gold Hall Haver Iver Kell Lind Lor Mar Mont Nor Oster Pell Quin Ram Sand Stern Tal Thorn Ulm Vern Wal Wex Yar Zel Brom Corv Drav Fen Kes Sab Tor Umb Vel".split()
ENDS = "haus mann berg quist ström sen son ley ford thorpe wick mond by ez ardo etti elli ova inska ski kar ier igny elle ault eau oux stein bach feld aby".split()
PLAIN = "Smith Johnson Miller García López Fernández Müller Schmidt Weber Dubois Lefèvre Moreau Rossi Novak Kowalski Okafor Nguyen Tanaka Patel Khan O'Brien O'Neill McKay D'Amico".split()

STREETS_EN = "Maple Oak Juniper Orchard Harrow Wren Mill Church Sparrow King Chestnut Lake Hill Ridge Bramble Kettle Station Willow".split()
KINDS_EN = "Street St. St Avenue Ave Ave. Road Rd. Rd Lane Ln Drive Dr. Court Ct. Close Terrace Blvd Boulevard Way Place Square".split()
STREETS_DE = "Gartenstraße Hauptstraße Lindenallee Mühlweg Schillerstr. Bahnhofstr. Kirchplatz Rosengasse Waldweg Seestrasse Bergring Parkallee Dorfstraße Uferweg Marktplatz Buchenring Rosenstr. Steindamm".split()
STREETS_DE2 = ["Am Alten Markt", "Hinterm Deich", "An der Kirche", "Unter den Eichen", "Auf dem Berg", "Zum Bahnhof", "Im Winkel", "Am Mühlbach", "Zur Alten Post", "Hinter der Mauer"]
KINDS_FR = "rue bd cours avenue boulevard chemin place impasse quai allée".split()
NAMES_FR = ["des Lilas", "du Moulin", "Victor Hugo", "de la Gare", "des Acacias", "aux Herbes", "du Vieux Pont", "de l'Église", "des Tilleuls", "Saint-Michel", "Pasteur", "du Port"]
KINDS_ES = "Calle C/ Avenida Avda. Av. Plaza Paseo Camino Ronda Travesía".split()
NAMES_ES = ["Mayor", "del Roble", "de la Ribera", "Fuente Nueva", "de los Olmos", "del Alcornoque", "San Juan", "Real", "de la Paz", "del Carmen"]
TOWNS = "Springmere Eastwick Lindental Pontclair Harrowgate Musterstadt Valbrune Dunmarrow Altenau Villanova Norwick".split()

# carriers: labelled slots are {name} {email} {phone} {id} {address}
CARRIERS = [
    "My name is {name} and I work on this.", "My name is {name}.", "I talked to Dr. {name} about it.", "Please ask {name} about it.", "The draft was written by {name} yesterday.", "This was assigned to {name}, as far as I know.",
    "cc {name} on the reply.", "Ms. {name} will review it.", "Mr. {name} signed.", "Mrs. {name} called.", "Prof. {name} wrote the note", "Thanks to {name} for the fix.", "{name} will join us later.", "I met {name} on the train.",
    "reviewer: {name}", "Owner: {name}", "Author: {name}\n", "Best,\n{name}\n", "Regards,\n{name}\n{phone}\n{address}", "Kind regards,\n{name}\n{email}", "--\n{name}\n{address}, <town>\n", "--\n{name}\nT {phone}\n", "Viele Grüße\n{name}\n{address}\nM: {phone}\n",
    "Mit freundlichen Grüßen\n{name}\n☎ {phone}\n", "Cordialement,\n{name}\n{address}\nT {phone}\n", "Saludos,\n{name}\n{phone}\n", "Un saludo,\n{name}\n",
    "- Name: {name}\n- <idlabel>: {id}\n- Tel: {phone}\n", "- Name: {name}\n- <idlabel>: {id}\n- Tel: {phone}\n <sentence>", "Name: {name}, Phone: {phone}, Email: {email}", "Nom : {name}\nAdresse : {address}\n", "Nombre: {name}\n",
    "```\nid,owner,mail,phone\n<n4>,{name},{email},{phone}\n<n4>,{name},{email},{phone}\n```", "id,owner,mail,phone\n<n4>,{name},{email},{phone}\n", "<n4>,{name},{email},{phone}\n<n4>,{name},{email},{phone}",
    '`{"name": "{name}", "contact": "{email}", "tries": <n1>}`', '{"user": "{name}", "phone": "{phone}"}', '{"name": "{name}", "mail": "{email}"}',
    "From: {name} <{email}>\nSubject: <slug>\n", "\nFrom: {name} <{email}>\nSubject: <slug>\n <sentence>", "To: {name} <{email}>", "WARN user={email} ip=<ip> retries=<n1>\n", "\nWARN user={email} ip=<ip> retries=<n1>\n <sentence>", "login {email} failed from <ip>",
    "Send the export to {email} .", "Send the export to {email}", "Contact: {email} (work).", "Contact: {email}.", "account {email}.", "account {email} (work).", "You can reach me at {email} .", "Mail me: {email}", "Write to {email} please.", "Schreib an {email} (work).", "Kontakt: {email}.",
    "Kontakt: {email} .", "Écris à {email} .", "copie à {email}.", "Mets en copie {email}", "Escribe a {email} .", "Contacto: {email}.", "mi correo es {email} .", "E-Mail an {email}, danke", "mailto:{email}", "my address is {email}, thanks", "<sentence> {email} <sentence>",
    "Call me on {phone}.", "Call me on {phone} after six.", "Phone: {phone} after six.", "Phone: {phone}", "Text {phone} <sentence>", "My number is {phone} after six.", "tel. {phone}.", "Tel: {phone}", "T {phone}", "M: {phone}", "☎ {phone}", "fax {phone}", "Ruf mich an: {phone}.", "Meine Nummer ist {phone} .",
    "Telefon {phone} bitte", "Erreichbar unter {phone} ab sechs.", "Appelle-moi au {phone} .", "Mon numéro : {phone}", "tél. {phone}.", "Llámame al {phone}", "Mi teléfono es {phone} .", "Móvil: {phone}", "WhatsApp {phone}", "<sentence> {phone} <sentence>",
    "Here: <idlabel> {id} <sentence>", "Here: <idlabel>: {id}.", "Here: <idlabel> is {id}.", "Here: <idlabel> = {id}", "Here: <idlabel> #{id}.", "My <idlabel> is {id}.", "<idlabel>: {id}", "- <idlabel>: {id}\n", "(<idlabel> {id})", "meine <idlabel> lautet {id}.", "mon <idlabel> est {id}.", "mi <idlabel> es {id}.", "<sentence> <idlabel> {id} <sentence>",
    "Ship the box to {address}.", "Ship the box to {address} please. <sentence>", "We live at {address}. <sentence>", "We live at {address} <sentence>", "The office moved to {address}, <town>", "The office moved to {address} <sentence>", "Come to {address}. <sentence>", "Come to {address}, <town> please.", "Address: {address}", "Address: {address}, <town>. <sentence>",
    "Anschrift: {address}, <zip> <town>. <sentence>", "Anschrift: {address} <sentence>", "Lieferung bitte an {address}, <zip> <town>", "Lieferung bitte an {address} please. <sentence>", "Wir wohnen in der {address}, <zip> <town>.", "Livraison au {address}, <zip> <town>.", "J'habite au {address} please. <sentence>", "Adresse : {address}. <sentence>",
    "Dirección: {address}, <zip> <town>", "Envíalo a {address}. <sentence>", "Vivo en {address} <sentence>", "{address}, <town>", "{address}\n<zip> <town>",
    "Frag bitte {name} danach.", "Ich heiße {name}, falls nötig.", "Ansprechpartnerin ist {name} im Büro.", "Laut Herrn {name} im Büro.", "Frau {name} ist abgesprochen.", "Das sagt Dr. {name}.", "Je m'appelle {name} si besoin.", "Demande à {name} avant ce soir.", "signé par {name}, merci.", "M. {name}, merci.", "Mme {name} arrive.", "avec {name} hier",
    "Me llamo {name} , por favor.", "Pregunta a {name} en la oficina.", "Habla con {name} , por favor.", "la Sra. {name} lo revisa.", "Don {name} llegó.", "responsable: {name}, por favor.", "el Sr. {name} firmó", "<sentence> {name} <sentence>",
    "<idlabel> {id} ref <uuid>", "Here: <idlabel> {id}. ref <uuid>", "Here: <idlabel> #{id}\nhttps://<word>.example/<word>", "Text {phone}\n<uuid>", "Appelle-moi au {phone}. ref <uuid>", "We live at {address}\n<uuid>", "cc {name} on the reply.\n<uuid>", "cc {name} and I own this.", "<sentence> cc {name} about it. <sentence>", "Ms. {name} and I own this.", "<sentence> / <word> Move <n2> Road Map cards",
    "Form says <idlabel> {id} <sentence>", "Form says <idlabel>: {id}. <sentence>", "Form says <idlabel> #{id}", "<idlabel> {id}", "<idlabel> {id}; <sentence>", "Here: <idlabel> {id}; <sentence>", "<idlabel> {id} <sentence>",
    "\nBest,\n{name}\n{address}\n☎ {phone}\n <sentence>", "\n--\n{name}\n{address}\n☎ {phone}\n <sentence>", "\nViele Grüße\n{name}\n{address}\nM: {phone}\n <sentence>", "\nCordialement,\n{name}\n{address}\n{phone}\n <sentence>", "\n--\n{name}\n{address}, <town>\nT {phone}\n <sentence>",
    "\nSaludos,\n{name}\n{address}\n{phone}\n <sentence>", "\nViele Grüße\n{name}\n{address}\n\nhttps://<word>.example", "\nBest,\n{name}\n{phone}\n <sentence>", "{name}\n{address}\n{phone}\n", "Mit Frau {name} abgesprochen.", "Mit Herrn {name} abgesprochen.", "Selon Mme {name} avant ce soir.", "Selon M. {name}, oui.", "Según Don {name} , por favor.",
    "<sentence> M. {name} avant ce soir. <sentence>", "<sentence> Selon Mme {name}, merci.", "Livraison au {address} <sentence>", "Dirección: {address} <sentence>", "Wir wohnen in der {address} please. <sentence>", "account {email} <sentence>", "<sentence> account {email}. <sentence>",
    "<sentence> Please ask {name} about it. <sentence>", "<sentence> Ms. {name} will review it. <sentence>", "<sentence> Call me on {phone}. <sentence>", "<sentence> Contact: {email} (work). <sentence>", "<sentence> We live at {address}. <sentence>",
]

# values in any surroundings: <w> is one to four words of SENTENCES, <Cap> ordinary words with capitals, <verb> what people do
CARRIERS += [
    "<w> {name} <w>.", "{name} <verb> <w>.", "<w> {name}, <w>.", "<w> {name} and {name} <w>.", "<w> by {name}.", "{name}, {name} and {name} <w>.", "{name}'s <w>", "<role> {name} <verb> <w>.", "the <role>, {name}, <verb> <w>.", "<W> {name} <verb>.", "<w> with {name} <w>", "<title> {name} <verb> <w>.", "<title> {name} and <title> {name} <verb>.",
    "<w> an {name}.", "<w> à {name} <w>.", "<w> con {name} <w>.", "<w>: {name}", "<W> {name} <w>.", "As {name} <w>, <w>.", "Dear {name}, <w>.", "<w>; {name} <verb> <w>.", "({name})", "<role>={name}", "<role>: {name}, <w>", "<w> {name} of <Cap>.", "<title> {name}, {address}, <verb>.", "<W> der <role> {name} <w>.", "Notre <role> {name} <w>.", "Nuestra <role> {name} <w>.",
    "<w> {email} <w>.", "<W>: {email}", "({email})", "<w> as {email} <w>", '<a href="mailto:{email}"><w></a>', "{email};{email}", "{email} <w>.", "<w>, {email}, <w>.", "<w> {email}: <w>",
    "<w> {phone} <w>.", "<phonelabel> {phone}", "<phonelabel>: {phone}, <w>", "<W> <phonelabel> {phone} <w>.", "<w> <phonelabel>, {phone}, <w>.", "<w> on {phone} or <w>.", '<phonelabel>="{phone}"', "<Cap> <phonelabel>: {phone}.", "<w> to {phone} to <w>", "<w> ({phone})",
    "<idlabel> {id} <w>.", "The <idlabel> is {id}.", "<w> <idlabel>, {id}, <w>.", "<w> <idlabel> ({id}) <w>.", "<w> <idlabel> no. {id} <w>", "<idlabel> {id}", "<w> <idlabel>: {id} <w>", "<idlabel> Nr. {id} <w>", "<w> <idlabel> {id} <w>.",
    "<w> {address}, <town>.", "<W> {address} <w>.", "{address} <w>.", "<role>: {address}, <zip> <town>", "<w> at {address} <w>.", "<w> in die {address} <w>.", "<w> in den {address}.", "<w> au {address}.", "<w> en {address} <w>.", "<w>: {address}, <w>", "<w> outside {address}.", "<w>, {address}, <w>.", "<w> von {address} <w>.", "<w> de {address} <w>.", "Flat <n1>, {address}, <town>", "<Cap> {address}, <w>", "<W> {address}.",
]

# nothing in these is personal
PLAIN_LINES = [
    "Move <n2> Road Map cards and <n2> Street View tiles to Sprint <n2>.", "Power Query and Knowledge Graph both need <n1> Docker images.", "Google Maps and Visual Studio Code are open.", "Order PO-<n5>-<n2> is <n2>.<n2> EUR, version <ver>.", "See build <n8>.<n2>, lot <year>-<n2>-<n4>.", "Epoch <n13> maps to row <n7>.",
    "The job ran as deploy@build-<n2> at <ip>:<n4>.", "Use `user@host` as a literal, and <n3>-<n3> as the id range.", "Pin react@<ver> and @types/<word>.", "ref <uuid>", "See https://<word>.example/<word>/<slug> ref https://<word>.test/<word>?id=<hex>", "git clone git@host:<word>/<word>.git", "ssh root@<word> -p <n4>",
    "Invoice <n6> of <year>-<n2>-<n2> is due on <n2>/<n2>/<year>.", "At <n2>:<n2>:<n2> on <n2> March <year> it stopped.", "Trace <uuid> ended.", "<sentence>\n<uuid> ", "<uuid>", "See <uuid> and legacy. [at] ref https://<word>.example/<word>", "sha <hex><hex>, ticket ABC-<n4>, port <n4>", "Ask Emil about it.", "Marta said so.", "Dear Hugo, thanks.", "Clara and Noor agreed.", "Best,\nGreta\n", "Frag Jonas oder Leonie.", "Hola Mateo, gracias.", "Merci Camille !",
    "The Hague and New York are far.", "Monday Morning is the name of the list.", "Docker Compose and Next Month are titles.", "#<slug> *api* [json] -> cli / regex cf, spark.", "```py\nrun('<slug>', <n2>)\n```", "```js\nconst Total = <n4>;\n```", '`{"name": "<slug>", "tries": <n1>}`', '{"id": <n6>, "title": "Big Plan", "ok": true}', "id,name,count\n<n4>,<slug>,<n2>\n",
    "My name is not important here.", "Please ask someone else about it.", "Please ask about it.", "This was assigned to nobody yet, as far as I know.", "This was assigned to another team.", "I talked to some people about it.", "The draft was written by hand yesterday.", "cc everyone here on the reply.", "Frag bitte noch einmal danach.",
    "Ich heiße das gut so.", "Demande à voir avant ce soir.", "Me llamo a engaño, por favor.", "Pregunta a todo el mundo en la oficina.", "Habla con otro equipo , por favor.", "signé par tous, merci.", "Laut diesem Bericht im Büro.", "Mit ganz anderen Worten abgesprochen.",
    "<sentence> <sentence>", "<sentence> <sentence> <sentence>", "<sentence>\n\n<sentence>", "Same for api. <sentence>", "<sentence> https://<word>.example/<slug>", "retry <n1> of <n2>, <n4> ms, <n2>% done", "Range <n4>-<n4>, pages <n2>-<n3>, ISBN later.", "192.168.<n2>.<n3> and 10.0.<n2>.<n2> answer.", "v<ver> replaces v<ver>.", "<n4> West is a tune.", "Chapter <n2> Hill is short.",
    # ordinary text with apostrophes, accents and nouns in capitals
    "J'ai relu l'exemple hier, c'est d'accord.", "Il n'y a qu'une réponse à l'énoncé d'hier, qu'on garde.", "L'équipe préfère l'ancien modèle plutôt allégé.", "Où s'arrête l'export, juste à côté du réglage d'arrivée ?", "C'est là qu'échoue l'appel, près de l'entrée d'index.", "Peut-être qu'il s'agit d'un détail déjà réglé, j'espère.",
    "Après l'essai, l'onglet s'ouvre à côté de l'autre.", "N'oublie pas l'annexe, d'ici là j'attends.", "Quelqu'un d'autre a vérifié l'état du côté de l'usine, n'est-ce pas ?", "D'après l'étude, l'écart s'élève à <n2> %.", "Aujourd'hui j'ai l'après-midi libre jusqu'à l'heure du dîner.", "déplacé, supprimé, renommé, préféré : l'ordre n'a pas d'importance",
    "Él dijo que sí, después añadió más páginas allí mismo.", "¿Qué pasó con la sección última? Está vacía también.", "Todavía falta revisar la versión más reciente del índice.", "Quizás según el árbol habría que añadir un renglón.", "Die Größe der Übersicht hängt vom Schlüssel ab, übrigens schon länger.", "Für das Gespräch nächste Woche fehlen noch Räume und Getränke.", "Meine Adresse ändert sich nächsten Monat, bitte merken.", "Die Liste heißt jetzt anders, die Prüfung läuft später.",
    "Wenn möglich, prüfe die Größe zuerst im Bericht der Abteilung.", "it's fine, we're done, that's what they've said", "don't rename what isn't yours, let's wait", "rock'n'roll o'clock, 'tis the season", "drag-and-drop, copy-paste, read-only, up-to-date", "vis-à-vis, c'est-à-dire, rendez-vous, peut-être, au-dessus", "user's guide, teachers' room, today's list", "My number is up, your phone is off.", "The passport is in the drawer, the phone on the desk.", "Mein Ausweis liegt zu Hause, das Telefon auch.",
    "Take 3 Maple syrups and 2 Oak boards.", "We tried 12 Orchard apples.", "Room <n3> on Level <n1>.", "Terminal <n1> Gate <n2>", "Windows <n2> and Python <n1>", "Ich habe <n2> Dateien im Ordner, <n3> Minuten im Übergabeplan.", "Für <slug> bräuchten wir <n4> Zeilen und der Entwurf im Nachtlauf.", "Vermutlich fehlt <slug> schon seit <n4> Minuten im Testordner. Danach wartet alles.",
    "Bitte lass das Archiv geöffnet und schiebe <slug> später in den Wochenbericht.", "Après <n3> fichiers, <slug> répète encore.", "On a essayé <slug> sur <n2> pages, sans toucher le brouillon.", "Probé <slug> con <n3> filas y la búsqueda aún se cayó.", "¿Puedes mirar por qué <slug> se cayó?", "<Cap> <Cap> <w>.", "<w> <Cap> <Cap> and <Cap> <Cap> <w>.", "<W> <Cap> <Cap>, <w>.", "The <Cap> <Cap> <w>.", "<place> <Cap> <w>.", "<w> <Cap> <place>, <w>.", "<w> <place> and <place> <w>.", "<W> <n2> <w>, <n3> <w>.", "<w> <n1> <Cap> <w>.", "<Cap> <n4>-<n2>-<n4> <w> <year>-<n2>-<n2>.", "<w> <n2>/<n2>/<year>, <w>.", "<Cap> <n2>, <Cap> <n2> and <Cap> B.", "<Cap> <n3> <w> <n1>.",
    "ISBN <n3>-<n1>-<n2>-<n6>-<n1> <w>.", "<w>: <n1>,<n3>,<n3>.<n2> <Cap> <w>.", "<Cap> <n4>, lot <n8>, qty <n3>.", "IP <ip>, port <n4>, <w> <n4>.", "Flight AB <n4> <w> C<n2> <w>.", "Error <n3>: <Cap> <Cap> in <Cap> <Cap>.", "<given> <verb> <w>.", "<w> <given> <w>.", "<W> <given>.", "<Cap> und <Cap>, <Cap> <n1>", "<title> <given> <verb>.", "<w> <place> Street <w>.", "<w> <n4> <w> <n1>.<n1>.<n1> <w>.", "Version <ver> of <place> <Cap> <w>.", "Zwischen <slug> und <slug> fehlt das Archiv, das erklärt die <n3> Dateien.",
]

SENTENCES = [
    "We tried <n3> rows of <slug> and the label still fails.", "I looked at the report in <slug> and it works after <n4> minutes.", "Let me open the old notebook first.", "There is a hidden query between <slug> and <slug>.", "Good idea, although <slug> expects it to be empty.", "Run <slug> again with <n4> tokens.",
    "That explains the layout: <slug> loops forever.", "Could you check why <slug> stops?", "My guess is that <slug> skips the header.", "I would rather rename <slug>.", "After the change, <slug> needed <n2> clicks less.", "Please keep the session small.", "In the graph view, <n4> runs went through.", "Danach läuft <slug> wieder.", "Mit <slug> war die Vorlage leer.",
    "Kannst du nachsehen, warum <slug> hängt?", "Ich habe die Abfrage in <slug> geprüft.", "Il faut garder le résumé.", "Entre <slug> et <slug>, il manque <n2> lignes.", "Très bien, mais <slug> préfère le plan.", "À mon avis, <slug> marche.", "Entre <slug> y <slug> faltaba el mensaje.", "Según <slug>, el título estará vacío mañana.", "Revisé la sesión en <slug>.",
    "Se lo mandé ayer.", "OK.", "Thanks!", "The nested thread of <slug> now prints twice.", "Use `<word>` here.", "It broke on Friday in the Review Queue.", "Same for cli.", "See <uuid>", "cf, docker.", "*json*", "See https://<word>.example/<slug>",
]

ID_LABELS = """SSN|social security number|my social|passport|passport no.|passport number|licence no.|driver's license|driving licence|ID card|ID card number|tax ID|national insurance number|NINO|NHS number|Steuer-ID|Steuer-IdNr.|Personalausweis|Personalausweisnummer|Reisepass|Reisepass Nr.|Sozialversicherungsnummer|
NIR|n° sécu|numéro de sécurité sociale|carte d'identité|passeport n°|DNI|DNI número|NIF|NIE|pasaporte|número de la seguridad social""".replace("\n", "").split("|")
#: More labels of documents of other countries, and of telephones.
ID_LABELS += "SIN|PESEL|CPF|Aadhaar|PAN|BSN|CURP|RFC|TFN|personnummer|fødselsnummer|CPR|codice fiscale|Medicare|identity card|identity number|national ID|tax number|Steuernummer|Ausweis|Ausweisnummer|Reisepassnummer|passeport|NI number|driver license|número de pasaporte|cédula|numéro fiscal|social security|insurance number".split("|")
PHONE_LABELS = "phone|Phone|tel|Tel|Tel.|mobile|Mobile|cell|Fax|fax|Handy|Rufnummer|Telefon|Festnetz|Teléfono|celular|móvil|téléphone|portable|pager|hotline|landline|helpline|WhatsApp|sms|call|ring|Dial|switchboard|desk|Durchwahl|Standard|fijo|number|Call".split("|")
ROLES = "colleague director manager engineer witness patient tenant coach neighbour brother teacher author owner contact doctor driver editor lawyer nurse reviewer guest client Kollege Nachbarin Leiterin collègue docteur directora doctora vecino".split()
TITLES_ = "Dr Dr. Mr Mr. Mrs Mrs. Ms Ms. Prof. Frau Herr Mme M. Sra. Sr.".split()
VERBS = "wrote called answered left lives met asked said chaired explained signed works presents arrived will attend declined studied came hat angerufen schreibt kam est arrivé parle a dit firmó llamó vive no atiende".split()
CAPS = "Machine Learning Deep Control Panel Network Settings Supreme Court Release Notes User Guide Holiday Monday Table Figure Great Wall Module Loader Server Project Status Report Cloud Storage Data Lake Open Source Black Friday Customer Success Board Meeting Design Review Sales Target Quality Team Annual Budget Change Request Public Health Final Draft Main Office Search Engine Risk Matrix Home Page Bericht Archiv Ordner Rapport Projet Informe Proyecto".split()
PLACES = "Berlin Paris London Madrid Google Microsoft Linux Python Java Amazon Oracle Europe Africa Asia Texas Florida Ontario Zealand York Geneva Vienna Adobe Mozilla Intel Oxford Cambridge Everest Atlantic Kubernetes Docker Postgres Wikipedia Toyota Boston Chicago Sevilla Lyon Hamburg".split()
# syllables of names that neither list has
ONSETS = "ab ad ak al am an ar as ba be bo bra ca cha chi da de do du e fa fe ga gi go ha he hu i is ja je ka ki ko la le li lo lu ma me mi mo na ne ni no o ola ou pa pe phi pri ra re ri ro sa se shi so su ta te thi to tu u va ve vi wa we xi ya yu za zi".split()
MIDDLES = "ra la na mi ri no sa de ka ta le vi nu lo ma di ni ro shi ya be go lu za ne".split()
CODAS = "n s r l na ra k sh m th ne ni o a i e ya ko wa nko mann son vic ski ian ez as os eau er et in".split()

MAIL_WORDS = "tessera plover brook halyard saltbox orchard post mail lumen quarry example gingko acme corp uni verlag".split()
MAIL_ENDS = "example example.com example.org co.test test invalid com org de fr es co.uk net".split()
PLAIN_WORDS = "falcon ledger ember probe basalt tracker mirror stitch relay cedar kernel onyx vault copper atlas weaver canyon hopper raven api sketch index".split()


#: The words of SENTENCES that have no capital.
COMMON = sorted({w for t in SENTENCES for w in re.findall(r"(?<![<\w])[^\W\d_]{2,}(?![>\w])", t) if w.islower()})


def _fold(s: str) -> str:
    return re.sub(r"[^a-z-]", "", s.lower().translate(str.maketrans("áàâäéèêëíìîïóòôöúùûüçñøå", "aaaaeeeeiiiioooouuuucnoa")))


class Filler:
    def __init__(self, seed: int, proper: list[str]):
        self.r = random.Random(seed)
        #: words that are written with a capital only: mostly names
        self.proper = proper

    def digits(self, n: int) -> str:
        return "".join(self.r.choice(string.digits) for _ in range(n))

    def family(self) -> str:
        r = self.r
        one = lambda: r.choice(PLAIN) if (x := r.random()) < 0.15 else r.choice(STEMS) + r.choice(ENDS) if x < 0.5 else self.known() if x < 0.7 else self.invented(2)
        name = one() if r.random() < 0.85 else f"{one()}-{one()}"
        if r.random() < 0.06:
            name = f"O'{name}"
        if r.random() < 0.05:
            name = name.upper()
        return (r.choice(["von ", "van der ", "de la ", "de ", "van ", "du ", "della ", "al-", "al-", "el-", "bin "]) if r.random() < 0.12 else "") + name

    def invented(self, least: int) -> str:
        r = self.r
        w = r.choice(ONSETS) + "".join(r.choice(MIDDLES) for _ in range(r.randint(least - 1, least))) + r.choice(CODAS)
        if r.random() < 0.12:
            w = w.replace(r.choice("aeiou"), r.choice("áéíóúäöüèêçñńşžłıễạ"), 1)
        return w.capitalize()

    def known(self) -> str:
        return self.r.choice(self.proper) if self.proper else self.invented(2)

    def name(self) -> str:
        # without capitals only names that begin with a usual given name can be told from other words
        if self.r.random() < 0.07:
            return f"{self.r.choice(GIVEN)} {self.family()}".lower()
        return self._name()

    def _name(self) -> str:
        r = self.r
        g = r.choice(GIVEN) if (x := r.random()) < 0.5 else self.known() if x < 0.68 else self.invented(1) if x < 0.92 else r.choice(string.ascii_uppercase) + r.choice(["ella", "oren", "imir", "aline", "ko", "una", "edra", "ish"])
        if r.random() < 0.1:
            g += "-" + self.invented(1) if r.random() < 0.5 else "-" + self.invented(1).lower()
        if r.random() < 0.12:
            g += f" {r.choice(string.ascii_uppercase)}."
        f = self.family()
        if r.random() < 0.07:
            return f"{f}, {g}"
        if r.random() < 0.04:
            g += " " + self.invented(1)
        return f"{f} {g}" if r.random() < 0.02 else f"{g} {f}"

    def email(self) -> str:
        r = self.r
        g, f = _fold(r.choice(GIVEN)).replace("-", ""), _fold(self.family())
        local = r.choice([f"{g}.{f}", f"{g}-{f}", f"{g[0]}{f}", f"{g}{r.randint(1, 99)}", f"{f}_{g}", f"{g}.{g[0]}.{f}", f"{g}_{f}", f"{g}{f}", f"{g}.{f}{r.randint(1, 99)}"])
        if r.random() < 0.15:
            local += "+" + r.choice(MAIL_WORDS)
        domain = [*(["mail"] if r.random() < 0.2 else []), r.choice(MAIL_WORDS) + ("-lab" if r.random() < 0.15 else ""), *r.choice(MAIL_ENDS).split(".")]
        how = r.random()
        if how < 0.72:
            m = f"{local}@{'.'.join(domain)}"
        elif how < 0.82:
            m = f"{local}(at){'.'.join(domain)}"
        elif how < 0.91:
            m = f"{local} [at] {' [dot] '.join(domain)}"
        else:
            m = f"{local} at {' dot '.join(domain)}"
        return m.upper() if r.random() < 0.08 else m

    def any_phone(self) -> str:
        """Seven to twelve digits in groups, after a country code or a zero, as anywhere in the world."""
        r, d = self.r, self.digits
        sep = r.choice(" " * 5 + "-" * 3 + ".")
        first = d(r.randint(2, 4))
        lead = r.choice([f"+{r.randint(1, 9)}{d(r.randint(0, 2))}{sep}{first}", f"+{r.randint(1, 9)}{d(1)}{sep}{first}", f"0{first}", f"0{first}", f"({first})", f"(0{first})", f"00{d(2)}{sep}{first}", f"1{sep}{d(3)}", first])
        rest = r.choice([[7], [6], [8], [3, 4], [4, 4], [3, 3], [2, 2, 2], [3, 2, 2], [2, 2, 2, 2], [3, 3, 2], [6, 1], [3, 3, 3], [5, 4], [5, 1]])
        if len(rest) == 1 and r.random() < 0.3:
            sep = r.choice("/ -")
        if re.fullmatch(r"\d{3}-", lead + sep) and rest[0] == 2:
            rest = [7]
        return lead + sep + (r.choice([sep, "-"]) if r.random() < 0.2 else sep).join(d(n) for n in rest)

    def any_id(self) -> str:
        """Groups of letters and digits as documents of other countries have them."""
        r, d, u = self.r, self.digits, lambda n: "".join(self.r.choice(string.ascii_uppercase) for _ in range(n))
        mixed = lambda n: u(1) + "".join(self.r.choice(string.ascii_uppercase + string.digits * 2) for _ in range(n - 2)) + d(1)
        sep = r.choice("   --.")
        any_ = lambda n: "".join(self.r.choice(string.ascii_uppercase + string.digits) for _ in range(n))
        group = lambda: d(r.randint(2, 5)) if r.random() < 0.8 else any_(r.randint(3, 5))
        return r.choice([lambda: "-".join([any_(3) + d(1), any_(3), any_(2) + d(2)]), lambda: sep.join([d(r.randint(3, 4)), *(group() for _ in range(r.randint(1, 3)))]), lambda: d(r.randint(8, 12)), lambda: u(r.randint(1, 3)) + d(r.randint(6, 9)), lambda: mixed(r.randint(7, 16)), lambda: u(1) + d(r.randint(6, 8)) + u(1), lambda: d(2) + u(2) + d(5), lambda: f"{d(8)}-{d(4)}", lambda: f"{u(1)}{d(4)}-{d(5)}-{d(5)}", lambda: f"{d(3)}.{d(3)}.{d(3)}-{d(2)}", lambda: u(2) + " " + " ".join(d(2) for _ in range(3)) + " " + u(1)])()

    def phone(self) -> str:
        r, d = self.r, self.digits
        if r.random() < 0.3:
            return self.any_phone()
        a, b = d(3), d(4)
        form = r.choice([
            f"({a}) 555-{b}", f"{a}-555-{b}", f"{a}.555.{b}", f"+1 {a} 555 {b}", f"+1{a}555{b}", f"1-{a}-555-{b}", f"({a}) 555-{b} ext. {d(3)}", f"+44 20 {d(4)} {d(4)}", f"020 {d(4)} {d(4)}", f"+44 (0)7{d(3)} {d(3)} {d(3)}", f"07{d(3)} {d(6)}",
            f"+49 30 {d(8)}", f"030/{d(5)}-{d(3)}", f"0{d(3)} {d(7)}", f"0049 {d(3)} {d(7)}", f"+49 (0){d(3)} {d(7)}", f"+33 {r.randint(1, 9)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{r.randint(1, 9)}.{d(2)}.{d(2)}.{d(2)}.{d(2)}", f"0{r.randint(1, 9)} {d(2)} {d(2)} {d(2)} {d(2)}",
            f"+34 {r.randint(6, 9)}{d(2)} {d(3)} {d(3)}", f"{r.randint(6, 9)}{d(2)} {d(3)} {d(3)}", f"+34{r.randint(6, 9)}{d(8)}", f"{r.randint(6, 9)}{d(2)} {d(2)} {d(2)} {d(2)}", f"0{r.randint(1, 9)}{d(8)}", f"0033 {r.randint(1, 9)} {d(2)} {d(2)} {d(2)} {d(2)}",
        ])
        if r.random() < 0.1:
            form = form.replace(" ", r.choice(["\xa0", " ", " "]))
        if r.random() < 0.05:
            form = form.replace("-", r.choice("‑–‐"))
        return form

    def id(self) -> str:
        r, d, u = self.r, self.digits, lambda n: "".join(self.r.choice(string.ascii_uppercase) for _ in range(n))
        mixed = lambda n: "".join(self.r.choice(string.ascii_uppercase + string.digits * 2) for _ in range(n))
        if r.random() < 0.25:
            return self.any_id()
        return r.choice([
            f"9{d(2)}-{d(2)}-{d(4)}", f"9{d(2)} {d(2)} {d(4)}", f"{d(3)}-{d(2)}-{d(4)}", f"{u(1)}{d(3)}-{d(4)}-{d(4)}", f"{d(2)} {d(3)} {d(3)} {d(3)}", f"00{d(9)}", f"{d(11)}", f"{d(8)}{u(1)}", f"{d(8)}-{u(1)}", f"{d(8)} {u(1)}", f"{u(1)}{d(7)}{u(1)}", f"{u(1)}-{d(7)}-{u(1)}",
            f"{r.choice('12')} {d(2)} {d(2)} {d(2)} {d(3)} {d(3)} {d(2)}", f"{r.choice('12')}{d(14)}", f"{u(1)}{mixed(6)}{d(2)}", f"{u(1)}{mixed(6)}{d(2)}", f"{u(3)}{mixed(4)}{d(2)}", f"{u(2)}{mixed(5)}{d(2)}", f"{u(1)}{d(8)}", f"{u(2)} {d(2)} {d(2)} {d(2)} {u(1)}", f"{d(3)} {d(3)} {d(4)}", f"{u(2)}{d(6)}{u(1)}",
        ])

    def address(self) -> str:
        r, kind = self.r, self.r.random()
        n = str(r.randint(1, 2400) if r.random() < 0.7 else r.randint(1, 99))
        if kind < 0.5:
            road = f"{r.choice(['', '', 'N. ', 'West ', 'South ', 'E. '])}{r.choice(STREETS_EN) if (x := r.random()) < 0.5 else self.invented(1) if x < 0.7 else self.known() if x < 0.85 else r.choice(CAPS)}{r.choice(['', '', '', ' Hill', ' Hollow'])} {r.choice(KINDS_EN)}"
            return f"{n} {road}{r.choice(['', '', '', f', Apt {r.randint(1, 40)}', f', Unit {r.randint(1, 9)}', f', Floor {r.randint(1, 60)}', ' NW'])}"
        n = str(r.randint(1, 199) if r.random() < 0.8 else r.randint(200, 3999))
        if kind < 0.68:
            road = r.choice(STREETS_DE) if (x := r.random()) < 0.45 else r.choice(STREETS_DE2) if x < 0.7 else self.invented(1) + r.choice("straße weg str. allee damm platz gasse ring ufer".split()) if x < 0.9 else f"{r.choice([self.invented(1) + 'er', 'Alte', 'Neue', 'Große', 'Kurze', 'Hohe'])} {r.choice(['Allee', 'Straße', 'Weg', 'Damm', 'Reihe', 'Gasse'])}"
            return f"{road} {n}{r.choice(['', '', 'a', 'b', ' c'])}"
        if kind < 0.84:
            return f"{n}{r.choice(['', ' bis', ' ter'])}{r.choice(['', '', ','])} {r.choice(KINDS_FR)} {r.choice(NAMES_FR) if r.random() < 0.6 else r.choice(['', 'de ', 'des ']) + (self.known() if r.random() < 0.4 else self.invented(2))}"
        return f"{r.choice(KINDS_ES)} {r.choice(NAMES_ES) if r.random() < 0.6 else r.choice(['', 'de ']) + (self.known() if r.random() < 0.4 else self.invented(2))}{r.choice([' ', ', ', ' n.º '])}{n}{r.choice(['', '', ', 3.º B', ', 2º izq.'])}"

    def filler(self, what: str) -> str:
        r, d = self.r, self.digits
        if what[0] == "n" and what[1:].isdigit():
            return str(r.randint(1, 9)) + d(int(what[1:]) - 1)
        word = r.choice(PLAIN_WORDS)
        if what in ("w", "W"):
            ws = [r.choice(COMMON) for _ in range(r.randint(1, 4))]
            return " ".join([ws[0].capitalize(), *ws[1:]] if what == "W" else ws)
        if what in ("Cap", "place", "verb", "role", "title", "given", "phonelabel"):
            return r.choice({"Cap": CAPS, "place": PLACES, "verb": VERBS, "role": ROLES, "title": TITLES_, "given": GIVEN, "phonelabel": PHONE_LABELS}[what])
        return {
            "slug": f"{word}-{r.choice(PLAIN_WORDS)}", "word": word, "ip": f"10.{r.randint(0, 255)}.{r.randint(0, 255)}.{r.randint(0, 255)}", "ver": f"{r.randint(0, 20)}.{r.randint(0, 20)}.{r.randint(0, 400)}", "year": str(r.randint(2019, 2027)),
            "hex": "".join(r.choice("0123456789abcdef") for _ in range(6)), "uuid": "-".join("".join(r.choice("0123456789abcdef") for _ in range(k)) for k in (8, 4, 4, 4, 12)), "town": r.choice(TOWNS), "zip": d(5), "idlabel": r.choice(ID_LABELS),
        }[what]


#: Rows that the tagger learns from.
ROWS = 20_000


def labelled(n: int = ROWS, seed: int = 11, lexicon: dict[str, str] | None = None) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """(text, [(start, end, type)]): the table, its slots filled; carriers come in turn, so that none is missing. ``lexicon`` gives words with capitals for names."""
    not_names = {w.lower() for w in PLACES + CAPS}
    fill = Filler(seed, sorted(w.capitalize() for w, kind in (lexicon or {}).items() if kind == "n" and len(w) > 2 and w not in not_names))
    slots = {"name": ("person_name", fill.name), "email": ("email", fill.email), "phone": ("phone", fill.phone), "id": ("id_number", fill.id), "address": ("street_address", fill.address)}
    out = []
    pool = CARRIERS + PLAIN_LINES
    for i in range(n):
        t = pool[i % len(pool)]
        while "<sentence>" in t:
            t = t.replace("<sentence>", fill.r.choice(SENTENCES), 1)
        text, spans = "", []
        for piece in re.split(r"(\{(?:name|email|phone|id|address)\}|<[A-Za-z]+\d*>)", t):
            if piece[:1] == "{" and piece[1:-1] in slots:
                kind, value = slots[piece[1:-1]]
                v = value()
                spans.append((len(text), len(text) + len(v), kind))
                text += v
            elif re.fullmatch(r"<(?!a>)[A-Za-z]+\d*>", piece):
                text += fill.filler(piece[1:-1])
            else:
                text += piece
        out.append((text, spans))
    return out
