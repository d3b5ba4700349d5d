"""Texts of elsewhere, written by hand for measuring only: no carrier, name, street or format of them was taken into the training table.

``{{type|value}}`` marks a value: n name, e email, p phone, i identity number, a street address.
"""

import re

KINDS = {"n": "person_name", "e": "email", "p": "phone", "i": "id_number", "a": "street_address"}
TEXTS = """
Our colleague {{n|Priyanka Subramaniam}} lives in Pune and commutes by train.
Yesterday {{n|Brian Cox}} explained entropy on the radio.
{{n|Barack Obama}} and {{n|Angela Merkel}} met in Berlin that spring.
The director, {{n|Takahashi Haruki}}, declined to comment.
According to {{n|Élise Fontaine}}, the figures were never audited.
name=John Doe was only a placeholder until {{n|Wilhelmina Achterberg}} replaced it.
Committee members: {{n|Oluwaseun Adeyemi}}, {{n|Katarzyna Wiśniewska}} and {{n|Duarte Carvalho}}.
I forwarded everything to {{n|Siobhán Gallagher}} last Tuesday.
{{n|Mohammed al-Farsi}} chaired the session; {{n|Lakshmi Venkataraman}} took minutes.
Has anyone heard from {{n|Gianluca Pellegrini}} since the merger?
Speaker bio: {{n|Ekaterina Sokolova}} studied mathematics at Kazan.
{{n|Rasmus Kjeldsen}}'s pull request broke the nightly build.
Signed, {{n|Hyun-woo Kang}}
Emergency contact is her brother {{n|Thabo Mokoena}}.
We hired {{n|Anneliese Obermayer}} as the new controller in March.
The painting once belonged to {{n|Ferdinand Waldmüller}} of Vienna.
Played by {{n|Cate Blanchett}}, the role won several awards.
Interview with {{n|Nkechi Eze}} about rural clinics.
Dr {{n|Farhad Karimi}} prescribed rest.
Mr {{n|Desmond Tutuola}} and Mrs {{n|Edith Tutuola}} will attend.
Unser Nachbar {{n|Friedhelm Kasparek}} hat angerufen.
Die Rechnung geht an {{n|Roswitha Brandstetter}}.
Gestern traf ich {{n|Ulrich Zimmermann}} in der Kantine.
Le rapport de {{n|Bertrand Delacroix}} est arrivé ce matin.
J'ai parlé avec {{n|Aurélie Marchand}} au téléphone.
Nous remercions {{n|Thibault Rousseau}} pour son aide.
Ayer vi a {{n|Guadalupe Villanueva}} en el mercado.
El contrato lo firmó {{n|Ezequiel Bustamante}} en Rosario.
La doctora {{n|Ximena Arriaga}} no atiende los lunes.
passenger: {{n|Ngô Thị Hạnh}}
Assigned reviewer is {{n|Bartholomew Higginbottom}}, not the bot.
{{n|Zeynep Yıldırım}} asked whether the budget had been approved.
Dear {{n|Cornelius Vanderbeek}}, thank you for your application.
As {{n|Marguerite Duval}} once noted, silence is also data.
Our tenants are {{n|Vikram Chaudhary}} and {{n|Sunita Chaudhary}}.
Please welcome {{n|Tomasz Lewandowski}} to the platform group.
The patient, {{n|Philippa Ashworth}}, was discharged on Monday.
Witness {{n|Ignatius Mwangi}} could not be reached.
In 2019 {{n|Greta Thunberg}} sailed across the Atlantic.
Coach {{n|Jürgen Klopp}} left the pitch early.
{{n|Mei-Ling Huang}} presents at noon, {{n|Abdulrahman Siddiqui}} at one.
Reach the registrar at {{e|registrar@kestrelcollege.edu}} before Friday.
Bounce report: {{e|no.such.user-42@mx.paperplane.io}} rejected.
{{e|h.ostrowski@institut-lyon.fr}} wrote back within an hour.
Bitte {{e|buchhaltung@waldhof-kliniken.de}} in CC nehmen.
Su dirección es {{e|pepita.jimenez_88@correo.com.ar}} según la ficha.
Reply-To: {{e|support+tickets@northwindfoods.co.nz}}
The key was registered to {{e|m_arslan@itu.edu.tr}} in 2021.
Forward invoices to {{e|AP-INBOX@GLOBEX.COM}} only.
username {{e|tsmith1974@btinternet.co.uk}}, password hidden
You may write to {{e|luisa at fundacion dot cl}} instead.
contact: {{e|d.petrov [at] sofia-lab [dot] bg}}
(mail {{e|quentin@duboisfreres.be}})
<a href="mailto:{{e|press@museum-aan-zee.nl}}">press</a>
{{e|ola.nordmann@posten.no}};{{e|kari.nordmann@posten.no}}
Signed up as {{e|xX_dragon_Xx@gmx.at}} yesterday
Error 550 for {{e|jeanne.darc@orleans.gouv.fr}}: mailbox full.
My private address, {{e|nightowl77@proton.me}}, still works.
Committer: {{e|36281+octofan@users.noreply.github.com}}
Newsletter goes to {{e|leser@abendblatt-verlag.ch}} und Partner.
Écrivez donc à {{e|mairie@saint-brevin.fr}} !
He used {{e|a@b.co}} as a test.
Alerts are sent to {{e|oncall.db@ops.fjordbank.com}} hourly.
Her old one was {{e|maria-jose.lopez@uni-sevilla.es}}, I think.
ping {{e|ravi.k@startup.in}} when done
The London office answers on {{p|020 7946 0958}} until five.
Moscow desk: {{p|+7 495 123-45-67}}
Ring {{p|(212) 736-5000}} and ask for the concierge.
Dial {{p|1-800-356-9377}} for support.
Her mobile is {{p|07911 123456}} these days.
Reception {{p|+61 2 9374 4000}}, Sydney.
Rufnummer {{p|089 1234567}} ist gestört.
Zentrale: {{p|+43 1 58858-0}} oder Fax.
Handy {{p|0171 2345678}}, nachmittags.
Joignable au {{p|06 12 34 56 78}} le soir.
Standard : {{p|+32 2 555 12 12}}
Mi celular: {{p|+52 55 1234 5678}}
Teléfono fijo {{p|91 123 45 67}} de la oficina.
Call the embassy: {{p|+81-3-3224-5000}}.
phone="{{p|+919876543210}}"
Text STOP to {{p|415.867.5309}} to opt out.
Delhi helpline {{p|011-23456789}} is open all day.
You can try {{p|+39 06 69821}} or walk in.
Switchboard {{p|+46 8 508 290 00}} after nine.
Ligue para {{p|+55 11 91234-5678}} ou mande mensagem.
His pager, {{p|0049-30-901820}}, is off.
mobile: {{p|+353 86 123 4567}}
Fax {{p|+1 (604) 822-2211}}, attention registry.
Notrufnummer des Hausmeisters: {{p|0664 1234567}}.
Contact by WhatsApp on {{p|+234 803 123 4567}}.
Front desk extension: {{p|(0117) 928 9000}}.
Tel {{p|04 76 57 45 00}} ou par courrier.
Night nurse {{p|+27 21 404 9111}} only in emergencies.
Landline: {{p|01865 270000}}
Hotline {{p|0800 1110 222}} kostenlos.
She left {{p|604-822-2211}} on the voicemail.
sms {{p|+31 6 12345678}}
Passport no. {{i|X1234567}} expires in May.
Her social security number, {{i|078-05-1120}}, was printed in full.
SSN {{i|219-09-9999}} appears twice.
The applicant's NI number is {{i|QQ 12 34 56 C}}.
National ID: {{i|19840412-2387}}
DNI {{i|12345678Z}} caducado.
NIE: {{i|Y7654321G}}
Steuernummer laut Bescheid: {{i|12 345 678 903}}
Ausweisnummer {{i|L01X00T471}} stimmt nicht.
Numéro de sécu {{i|1 85 05 78 006 084 36}} illisible.
Passeport {{i|14AB56789}} délivré à Lille.
driver license {{i|D1234-56789-01234}} suspended
Passport number: {{i|C01X00T47}}
Tax ID {{i|912-34-5678}} on the form.
PESEL {{i|44051401359}} was mistyped.
Aadhaar: {{i|2345 6789 0124}}
CPF {{i|111.444.777-35}} não confere.
ID card no {{i|AB123456C}} was scanned.
Reisepassnummer {{i|C4VZ0G8M1}} notiert.
Her passport ({{i|533380006}}) was stolen.
medicare no. {{i|1EG4-TE5-MK73}}
NHS number {{i|943 476 5919}} on the wristband
codice fiscale {{i|RSSMRA85T10A562S}}
BSN: {{i|111222333}}
social security {{i|457-55-5462}} verified
número de pasaporte {{i|XDB123456}} vencido
identity card {{i|E12345678}} presented
Personalausweis Nr. {{i|T22000129}} gültig bis 2031.
CURP {{i|GODE561231HDFRRN04}} registrada.
Send flowers to {{a|221B Baker Street}}, London.
The clinic is at {{a|1600 Pennsylvania Avenue NW}}, Washington.
Ms {{n|Jennifer Lawson}}, {{a|22 Baker St}}, called twice.
He grew up at {{a|742 Evergreen Terrace}} in Springfield.
Deliver to {{a|350 Fifth Avenue, Floor 34}} before noon.
My flat: Flat 4, {{a|17 Gloucester Road}}, Bristol
Wohnhaft {{a|Friedrichstraße 43}}, 10117 Berlin.
Bürositz: {{a|Am Sandtorkai 56}}, 20457 Hamburg
Er zog in die {{a|Leopoldstr. 12b}} um.
Rechnung an {{a|Kaiserdamm 101}}, 14057 Berlin
Siège : {{a|14 rue de Rivoli}}, 75004 Paris
Elle habite {{a|8 bis, avenue Foch}} depuis mai.
Le cabinet se trouve {{a|27 boulevard Haussmann}}.
Domicilio: {{a|Calle de Alcalá, 45}}, Madrid
Nos mudamos a {{a|Paseo de Gracia 92}}, Barcelona.
El taller está en {{a|Avenida Libertador 1473}}.
Return label: {{a|4059 Mount Lee Drive}}, Hollywood
{{a|10 Downing Street}} was cordoned off.
Property listed: {{a|58 Lombard Crescent}}, three bedrooms.
He parked outside {{a|1313 Mockingbird Lane}}.
Lieferadresse {{a|Lange Reihe 7}}, Hinterhaus
Die Praxis zieht in den {{a|Tulpenweg 19}}.
La tienda de {{a|Plaza España 3}} cerró.
Adresse de livraison : {{a|3 impasse des Cerisiers}}, Nantes
Ship it: {{a|77 Massachusetts Ave}}, Cambridge MA
The notary sits at {{a|9 St. Stephen's Green}}.
Old HQ, {{a|1 Hacker Way}}, Menlo Park
Treffpunkt {{a|Schönhauser Allee 180}}, zweiter Stock.
Mon bureau est au {{a|112 quai de Jemmapes}}.
La notaría de {{a|Calle Serrano 21}} abre a las nueve.
The Great Wall and Mount Everest were on the itinerary.
Machine Learning and Deep Learning are not synonyms.
United Nations delegates left Geneva on Sunday.
Open the Control Panel, then Network Settings.
Version 12.4.1 of Adobe Acrobat crashes on Windows Server.
Order 4471-99-2031 shipped on 2024-11-05 at 14:32:07.
The Supreme Court and the House of Commons disagreed.
Born on 12/04/1984, aged 39.
Flight LH 1234 leaves gate B22 at 07:45.
Commit 9f8e7d6c5b4a touched 128 files.
IP 192.0.2.146, port 8443, ttl 3600.
ISBN 978-3-16-148410-0 is out of print.
Use npm run build, then npm test.
Bank Holiday Monday means no deliveries.
See Table 4, Figure 12 and Appendix B.
The train passes Baker Street every 4 minutes.
Total: 1,234,567.89 USD for 365 days.
New Zealand beat South Africa in Cape Town.
Bundesministerium für Gesundheit, Referat 3
La Guerre et la Paix est un long roman.
El Niño vuelve cada 4 o 5 años.
Room 101 on Floor 3 is free.
User Guide and Release Notes are on Google Drive.
Error 404: Not Found in Module Loader.
UUID 550e8400-e29b-41d4-a716-446655440000 is taken.
Priyanka called twice.
Tell Brian about it.
Dear Sir or Madam, Happy New Year!
SKU 8827-AX, batch 20240917, qty 250.
Mix 200 g flour with 3 eggs and 125 ml milk.
""".strip().split("\n")


#: Written after the table was finished, and never looked at while it changed.
LATER = """
The keynote by {{n|Rosalind Okonkwo}} starts at ten.
I owe {{n|Matthias Feldkamp}} an answer since Friday.
{{n|Beatriz Quintanilha}} rejected the draft twice.
Nurse {{n|Gwendolyn Pritchard}} was on duty that night.
Both {{n|Kenji Watanabe}} and {{n|Salma Benhaddou}} voted against it.
The minutes were taken by {{n|Oskar Lindqvist}}.
Herr {{n|Tobias Reichenbach}} bittet um Rückruf.
Das Gutachten stammt von {{n|Henriette Mühlbauer}}.
Mon voisin {{n|Gérard Lacombe}} a trouvé le chat.
Madame {{n|Solange Ndiaye}} préside la séance.
El ingeniero {{n|Rodrigo Manterola}} revisó los planos.
Firmado: {{n|Inmaculada Carrasco}}
approver = {{n|Dmitry Voronov}}
Ask {{n|Fiona MacAllister}} whether the keys were returned.
Guests: {{n|Chukwuemeka Obi}}, {{n|Ingeborg Hallström}}.
Refunds: {{e|billing-desk@harbourline.ie}}
Her login is {{e|p.novakova@ctu-praha.cz}}, not the old one.
{{e|no-reply@notify.lakeside.gov.au}} keeps bouncing
Escríbanos a {{e|atencion.cliente@ferreteria-lopez.mx}} hoy mismo.
Anfragen an {{e|info@tischlerei-bauer.at}} richten.
copie : {{e|f.garnier@ecole-du-sud.fr}}
reach out to {{e|tanya [at] bluefin [dot] io}} first
list owner {{e|ops+alerts@stack.example.net}} confirmed
Voicemail from {{p|+1 312 555 0188}} yesterday.
Kundendienst: {{p|0821 4567890}}
Rappelez le {{p|01 42 68 53 00}} avant midi.
Oficina central {{p|+34 915 550 123}}.
emergency line {{p|(02) 9876 5432}}
Text {{p|555-867-5309}} when you land.
Mobil: {{p|+41 79 123 45 67}}
WhatsApp {{p|+55 21 98765-4321}} only
desk phone {{p|020 8123 4567}}, ask for Jo
SSN: {{i|536-22-8841}}
Her passport number is {{i|K08942137}}.
DNI {{i|48213976M}} adjunto.
Personalausweis: {{i|LZ6311T475}}
tax ID {{i|27 481 905 336}}
NINO {{i|AB 98 76 54 C}} is on file.
driving licence {{i|MORGA657054SM9IJ}}
numéro de sécurité sociale {{i|2 91 03 75 116 042 18}}
Parcel for {{a|48 Wellington Road}}, Dublin
She rents {{a|9 Copper Kettle Lane}} with two friends.
Werkstatt: {{a|Industriestraße 27}}, Hof
Treffen in der {{a|Goethestr. 5}} um acht.
Atelier au {{a|61 rue des Martyrs}}, Paris
Cita en {{a|Calle Mayor 14}}, segundo piso.
Mail goes to {{a|2100 Riverside Drive, Apt 6}}.
Büro im {{a|Lindenweg 88}}.
The Blue Whale and Giant Squid exhibits reopen in June.
Visual Basic and Delphi were taught in Room 204.
Invoice 20931-A totals 1,482.60 EUR, due 2025-03-31.
Version 7.12 of Mozilla Thunderbird syncs every 15 minutes.
The European Commission met in Brussels on 4 July 2023.
Chapter 9 covers Linear Algebra, pages 201-244.
Bus 42 stops at Station Road every 20 minutes.
Tracking code 1Z999AA10123456784 was scanned.
Der Deutsche Bundestag tagt im Reichstag.
Le Petit Prince est traduit en 300 langues.
""".strip().split("\n")


def held_out(lines: list[str] = TEXTS) -> list[tuple[str, set[tuple[int, str]]]]:
    """(text, {(first character, type)})"""
    out = []
    for line in lines:
        text, spans = "", set()
        for i, piece in enumerate(re.split(r"\{\{(\w\|[^}]*)\}\}", line)):
            if i % 2:
                kind, value = piece.split("|", 1)
                if kind in KINDS:
                    spans.add((len(text), KINDS[kind]))
                text += value
            else:
                text += piece
        out.append((text, spans))
    return out
