"""Problem 8 on texts that are in none of the tables: cases and clear texts of several languages, written for this test."""

from kmerframe.llm import residue

CASES = [
    # slots
    "Dear {first_name},\n\nthank you.", "Hello {{ user.first_name | title }}, welcome.", "# <%= @report.title %>", "Invoice for <%= @customer.name %>", "# ${report.title}", "Author: [Name]\nDate: [Date]",
    "# {project_name}\n\nA short note on the river.", "Title: {{ cookiecutter.project_slug }}", "{{#items}}\n{{name}}\n{{/items}}", "# {% block title %}", "INSERT TEXT HERE", "# [Your Project Title]\n\n[Insert a short summary of the project]",
    "Contact: <your email>", "Autor: {{ autor }}\nDatum: {{ datum }}", "# @@TITEL@@", "Estimado {nombre}:", "Nom : {{ nom }}\nTitre : {{ titre }}", "Naam: [[naam]]", "Тема: {{ тема }}", "Course: %COURSE_NAME%",
    # prompts
    "# Homework 2\n\nType your answer here", "Scrivi qui la tua risposta", "Vul hier je antwoord in", "Wpisz tutaj swoją odpowiedź", "Введите свой ответ здесь", "ここに答えを入力してください", "请在此处输入您的答案", "Edit this cell.", "```python\n# YOUR CODE HERE\npass\n```",
    # filler
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor.", "text text text text text text text text text text", "Dit is opvultekst voor deze paragraaf.", "sdf jkl asd fjkl dsa lkj fds jkl ads", "Background: tbd\nMethods: to come\nResults: pending",
    "Bramtus veldon corvath sempri. Veldon marsuk corvath bramtus, sempri veldon toruk corvath. Marsuk bramtus toruk veldon sempri corvath.", "Testo segnaposto.",
    # errors and notices
    "Your browser does not support JavaScript!", "Checking your browser before accessing the site.", "You must log in to view this page", "API rate limit exceeded", "Not Found\n\nThe requested URL /a/b.html was not found on this server.\n\nApache/2.4.41 (Ubuntu) Server at host Port 80",
    "500 Internal Server Error\n\nTraceback (most recent call last):\n  File \"app.py\", line 3, in run\n    main()\n  File \"app.py\", line 9, in main\n    raise ValueError(x)\nValueError: x", "Please enable cookies and reload.", "JavaScript muss aktiviert sein, um diese Seite zu sehen.",
    "Per visualizzare questa pagina è necessario abilitare JavaScript.", "Pagina non trovata", "Errore 404", "Schakel JavaScript in om deze pagina te bekijken.", "De pagina is niet gevonden.", "Включите JavaScript в браузере.", "Страница не найдена", "Доступ запрещён.",
    "このページを表示するにはJavaScriptを有効にしてください。", "ページが見つかりません", "请启用 JavaScript 以继续。", "页面不存在", "Strona nie została znaleziona.", "Włącz obsługę JavaScript w przeglądarce.", "{\"message\": \"Not Found\", \"status\": \"404\"}", "Sidan hittades inte.",
]
CLEAR = [
    # other languages, one line of prose each
    "Il treno parte ogni mattina alle sette e arriva prima di mezzogiorno.", "De trein vertrekt elke ochtend om zeven uur en komt voor de middag aan.", "Pociąg odjeżdża codziennie rano o siódmej i przyjeżdża przed południem.", "Поезд отправляется каждое утро в семь часов и прибывает до полудня.",
    "Kereta berangkat setiap pagi pukul tujuh dan tiba sebelum tengah hari.", "Juna lähtee joka aamu seitsemältä ja saapuu ennen puoltapäivää kaupunkiin.", "Tåget går varje morgon klockan sju och kommer fram före lunch.", "Tren her sabah yedide kalkar ve öğleden önce varır.", "列車は毎朝七時に出発し、正午前に到着します。", "火车每天早上七点出发，中午之前到达。",
    "Vesistöjen pintalämpötilat vaihtelevat vuodenaikojen mukaan huomattavasti pohjoisessa Suomessa.", "Aardbeien, frambozen, bramen, kersen, pruimen, appels, peren, druiven.", "Anna Schmidt, Peter Meier, Paula Fischer, Jonas Weber, Laura Wagner, Felix Becker", "latitude longitude elevation temperature pressure humidity windspeed rainfall",
    "Moskau, Berlin, Paris, Madrid, Warschau, Helsinki, Stockholm, Lissabon", "Der Zug fährt jeden Morgen um sieben Uhr ab.", "Le train part chaque matin à sept heures.", "El tren sale cada mañana a las siete.", "O trem parte todas as manhãs às sete.", "Kaikki mittaukset tehtiin samana päivänä.",
    # signs with other uses
    "The function takes vector<int> and map<string> as arguments.", "Override __init__ or __eq__ in the subclass.", "The set \\{x, y\\} has two elements, $\\{a\\}$ one.", "See [[River]] and [[Lake]] for the places that we visited in spring and in autumn.", "In Jinja a name between double braces, such as {{ name }}, is replaced when the page is rendered.",
    "Use {{name}} in Mustache and ${name} in the shell.", "The values are in {a} and {b}, the two sets of the first chapter.", "He called it «un jour de fête», and so it was.", "Press <Enter> to go on, or <Esc> to stop.", "The box [A] is to the left of the box [B] in the second drawing of the series.",
    "Set ${HOME} before you start the program, and do not forget the path.", "Angles below 5% or above 95% are left out of the count.", "See [the guide](http://a.b/c) and [1].", "- [x] done\n- [ ] open", "The C++ template parameter <T> may be any type.", "Das Modell «Sommer» verkauft sich gut.", "Replace {year} with the year in the format string.", "Le mot «maison» vient du latin mansio, et non du grec.",
    # scripts and errors as a subject
    "We count the 404 errors of each day and plot them.", "The handler returns 403 Forbidden if the session has expired.", "Our crawler retries with a delay when the server answers Too Many Requests.", "In this chapter we learn how to enable JavaScript in a headless browser.", "Dieses Kapitel erklärt, wie ein Server auf eine Anfrage antwortet.", "The table shows how often a page was not found, by week.",
    "Users without cookies are left out of the analysis.", "The access log has four columns: time, address, path and status code.", "A client that gets 503 waits and tries again.", "# Error handling\n\nA function that fails returns an error; the tests below show how.", "Students should log in before the lesson begins.", "The history of JavaScript begins in 1995, when it was written in ten days.",
    "Cookies are baked at 180 degrees for ten minutes.", "The actors need the script before the first rehearsal.", "El capítulo trata de los errores de un servidor.", "Ce chapitre traite des erreurs d'un serveur.",
    # talk of filler and prompts
    "The string `lorem ipsum` is used as dummy input in the tests.", "Very very good, we said, and good it was.", "no, no, no, she said", "The answer is here: forty-two.", "The name of the rose is a novel of 1980.", "Type inference is done by the compiler.",
]


def test_held_out():
    found = [x for x in CASES if residue.is_residue(x)]
    wrong = [x for x in CLEAR if residue.is_residue(x)]
    assert len(CASES) >= 60 and len(CLEAR) >= 60
    assert len(found) >= 0.9 * len(CASES), [x for x in CASES if x not in found]
    assert len(found) >= 0.9 * (len(found) + len(wrong)), wrong
