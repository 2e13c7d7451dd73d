"""Names with a meaning in HTML tree construction. All sets are fixed values of the HTML standard."""

from __future__ import annotations

from .chars import HTML, MATHML, SVG, XLINK, XML, XMLNS


def _html(names: str) -> frozenset[tuple[str, str]]:
    return frozenset((HTML, name) for name in names.split())


INTEGRATION_MATHML = frozenset((MATHML, n) for n in "mi mo mn ms mtext".split())
INTEGRATION_SVG = frozenset((SVG, n) for n in "foreignObject desc title".split())
_BOUNDARY = INTEGRATION_MATHML | INTEGRATION_SVG | {(MATHML, "annotation-xml")}

SPECIAL = _BOUNDARY | _html(
    "address applet area article aside base basefont bgsound blockquote body br button caption center col colgroup dd details dir div dl dt embed fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe img input isindex keygen li link listing main marquee menu meta nav noembed noframes noscript object ol p param plaintext pre script search section select source style summary table tbody td template textarea tfoot th thead title tr track ul wbr xmp"
)
SCOPE = _BOUNDARY | _html("applet caption html table td th marquee object select template")
LIST_SCOPE = SCOPE | _html("ol ul")
BUTTON_SCOPE = SCOPE | _html("button")
TABLE_SCOPE = _html("html table template")
IMPLIED_END = frozenset("dd dt li optgroup option p rb rp rt rtc".split())
IMPLIED_END_THOROUGH = IMPLIED_END | frozenset("caption colgroup tbody td tfoot th thead tr".split())
FORMATTING = frozenset("b big code em font i s small strike strong tt u".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCKS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer header hgroup main nav ol p search section summary ul".split())
BLOCK_ENDS = (BLOCKS - {"p"}) | frozenset("button listing menu pre select".split())
MAY_STAY_OPEN = frozenset("dd dt li optgroup option p rb rp rt rtc tbody td tfoot th thead tr body html".split())
FORM_OWNED = frozenset("button fieldset input object output select textarea img".split())
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
RAW_TEXT = frozenset("style script xmp iframe noembed noframes plaintext".split())

#: Start tags that end foreign content.
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())

_SVG_TAGS = "altGlyph altGlyphDef altGlyphItem animateColor animateMotion animateTransform clipPath feBlend feColorMatrix feComponentTransfer feComposite feConvolveMatrix feDiffuseLighting feDisplacementMap feDistantLight feDropShadow feFlood feFuncA feFuncB feFuncG feFuncR feGaussianBlur feImage feMerge feMergeNode feMorphology feOffset fePointLight feSpecularLighting feSpotLight feTile feTurbulence foreignObject glyphRef linearGradient radialGradient textPath"
_SVG_ATTRIBUTES = "attributeName attributeType baseFrequency baseProfile calcMode clipPathUnits diffuseConstant edgeMode filterUnits glyphRef gradientTransform gradientUnits kernelMatrix kernelUnitLength keyPoints keySplines keyTimes lengthAdjust limitingConeAngle markerHeight markerUnits markerWidth maskContentUnits maskUnits numOctaves pathLength patternContentUnits patternTransform patternUnits pointsAtX pointsAtY pointsAtZ preserveAlpha preserveAspectRatio primitiveUnits refX refY repeatCount repeatDur requiredExtensions requiredFeatures specularConstant specularExponent spreadMethod startOffset stdDeviation stitchTiles surfaceScale systemLanguage tableValues targetX targetY textLength viewBox viewTarget xChannelSelector yChannelSelector zoomAndPan"
SVG_TAGS = {name.lower(): name for name in _SVG_TAGS.split()}
SVG_ATTRIBUTES = {name.lower(): name for name in _SVG_ATTRIBUTES.split()}
MATHML_ATTRIBUTES = {"definitionurl": "definitionURL"}
#: Attributes that get a namespace in foreign content: prefix, namespace, local name.
FOREIGN_ATTRIBUTES = (
    {f"xlink:{n}": ("xlink", XLINK, n) for n in "actuate arcrole href role show title type".split()}
    | {f"xml:{n}": ("xml", XML, n) for n in "lang space".split()}
    | {"xmlns": (None, XMLNS, "xmlns"), "xmlns:xlink": ("xmlns", XMLNS, "xlink")}
)

QUIRKS_PUBLIC = ("-//w3o//dtd w3 html strict 3.0//en//", "-/w3c/dtd html 4.0 transitional/en", "html")
QUIRKS_SYSTEM = ("http://www.ibm.com/data/dtd/v11/ibmxhtml1-transitional.dtd",)
QUIRKS_PREFIXES = (
    "+//silmaril//dtd html pro v0r11 19970101//",
    "-//advasoft ltd//dtd html 3.0 aswedit + extensions//",
    "-//as//dtd html 3.0 aswedit + extensions//",
    "-//ietf//dtd html 2.0 level 1//",
    "-//ietf//dtd html 2.0 level 2//",
    "-//ietf//dtd html 2.0 strict level 1//",
    "-//ietf//dtd html 2.0 strict level 2//",
    "-//ietf//dtd html 2.0 strict//",
    "-//ietf//dtd html 2.0//",
    "-//ietf//dtd html 2.1e//",
    "-//ietf//dtd html 3.0//",
    "-//ietf//dtd html 3.2 final//",
    "-//ietf//dtd html 3.2//",
    "-//ietf//dtd html 3//",
    "-//ietf//dtd html level 0//",
    "-//ietf//dtd html level 1//",
    "-//ietf//dtd html level 2//",
    "-//ietf//dtd html level 3//",
    "-//ietf//dtd html strict level 0//",
    "-//ietf//dtd html strict level 1//",
    "-//ietf//dtd html strict level 2//",
    "-//ietf//dtd html strict level 3//",
    "-//ietf//dtd html strict//",
    "-//ietf//dtd html//",
    "-//metrius//dtd metrius presentational//",
    "-//microsoft//dtd internet explorer 2.0 html strict//",
    "-//microsoft//dtd internet explorer 2.0 html//",
    "-//microsoft//dtd internet explorer 2.0 tables//",
    "-//microsoft//dtd internet explorer 3.0 html strict//",
    "-//microsoft//dtd internet explorer 3.0 html//",
    "-//microsoft//dtd internet explorer 3.0 tables//",
    "-//netscape comm. corp.//dtd html//",
    "-//netscape comm. corp.//dtd strict html//",
    "-//o'reilly and associates//dtd html 2.0//",
    "-//o'reilly and associates//dtd html extended 1.0//",
    "-//o'reilly and associates//dtd html extended relaxed 1.0//",
    "-//softquad software//dtd hotmetal pro 6.0::19990601::extensions to html 4.0//",
    "-//softquad//dtd hotmetal pro 4.0::19971010::extensions to html 4.0//",
    "-//spyglass//dtd html 2.0 extended//",
    "-//sq//dtd html 2.0 hotmetal + extensions//",
    "-//sun microsystems corp.//dtd hotjava html//",
    "-//sun microsystems corp.//dtd hotjava strict html//",
    "-//w3c//dtd html 3 1995-03-24//",
    "-//w3c//dtd html 3.2 draft//",
    "-//w3c//dtd html 3.2 final//",
    "-//w3c//dtd html 3.2//",
    "-//w3c//dtd html 3.2s draft//",
    "-//w3c//dtd html 4.0 frameset//",
    "-//w3c//dtd html 4.0 transitional//",
    "-//w3c//dtd html experimental 19960712//",
    "-//w3c//dtd html experimental 970421//",
    "-//w3c//dtd w3 html//",
    "-//w3o//dtd w3 html 3.0//",
    "-//webtechs//dtd mozilla html 2.0//",
    "-//webtechs//dtd mozilla html//",
)
LIMITED_PREFIXES = ("-//w3c//dtd xhtml 1.0 frameset//", "-//w3c//dtd xhtml 1.0 transitional//")
HTML4_PREFIXES = ("-//w3c//dtd html 4.01 frameset//", "-//w3c//dtd html 4.01 transitional//")
