"""A page with a card, as the parser's tests read it."""

FIXTURE = """<table class="infobox">
 <tr><th>Глава</th><td><span data-wikidata-property-id="P6"><a href="./%D0%90%D0%B1%D0%B2">Абв Г.</a>[1]</span></td></tr>
 <tr><th>Население</th><td>↗ 700&nbsp;000</td></tr>
 <tr><th>Флаг</th><td>x</td></tr>
</table>
<p>Вводный текст.</p>
<h2>Городская власть</h2><p>Первый раздел.</p>
<h3>Мэры</h3><ul><li>Имя Один</li></ul>
<h2>Экономика</h2><p>Завод.</p>"""
